"""Strength, reinforcement and recency expressions. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction; negative if ``earlier`` is later."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def current_strength(now: Column, base="base_strength", rate="decay_rate", importance="importance", last="last_accessed_at", pinned="is_pinned") -> Column:
    decay = F.col(rate) * (1 - F.col(importance) * 0.5)
    return F.when(F.col(pinned), F.col(base)).otherwise(F.col(base) * F.exp(-decay * days_between(now, F.col(last))))


def day_of(t: Column) -> Column:
    """Days since 1970, with their fraction."""
    return days_between(t, F.lit("1970-01-01").cast("timestamp"))


#: The day of what never comes; what has always been is as far back.
NEVER = 1e300


def crossing_day(threshold: float, base="base_strength", rate="decay_rate", importance="importance", last="last_accessed_at", pinned="is_pinned") -> Column:
    """The day from which on the strength is below the threshold, but for the rounding of its logarithm; null where it grows."""
    decay = F.col(rate) * (1 - F.col(importance) * 0.5)
    stays = F.col(pinned) | (decay == 0) | (F.col(base) <= 0)
    always = F.when(F.col(base) < threshold, -NEVER).otherwise(NEVER)
    return F.when(stays, always).when(decay > 0, day_of(F.col(last)) + F.ln(F.col(base) / threshold) / decay)


def below(threshold: float, now: Column, day: str) -> Column:
    """Strength below the threshold, with the stored day of a threshold that is no lower: a range that reaches the files, and then the exact test."""
    return (F.col(day).isNull() | (F.col(day) <= day_of(now) + 1e-6)) & (current_strength(now) < threshold)


def is_current() -> Column:
    return F.col("valid_until").isNull() & ~F.col("is_archived")


def is_expired(now: Column) -> Column:
    return F.col("expires_at").isNotNull() & (now > F.col("expires_at"))


def reinforced(base: Column, count: Column, accesses: Column, factor: float = 0.1) -> Column:
    """The base strength after so many further accesses: each adds factor / sqrt(its number)."""
    more = F.when(accesses > 0, F.transform(F.sequence(count + 1, count + accesses), lambda k: F.lit(factor) / F.sqrt(k))).otherwise(F.array().cast("array<double>"))
    return base + F.aggregate(more, F.lit(0.0), lambda s, x: s + x)


def strength_score(strength: Column) -> Column:
    return F.least(F.lit(1.0), strength / 2)


def recency_score(now: Column, last: Column, horizon: float = 365.0) -> Column:
    """1 at once, 0 from the horizon on; above 1 for accesses in the future."""
    age = days_between(now, last)
    return F.when(age >= horizon, 0.0).otherwise(1 - age / horizon)
