"""Vector expressions over arrays of numbers, summed in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance of vectors that have none.
FAR = 3.4028234663852886e38


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def comparable(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero or unequally long vectors."""
    scale = norm(a) * norm(b)
    return F.when(comparable(a, b) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def normalized_cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0 to 1: what cannot be compared is 0.5."""
    return (cosine(a, b) + 1) / 2


def euclidean(a: Column, b: Column) -> Column:
    return F.when(comparable(a, b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))).otherwise(FAR)


def l2_normalized(a: Column) -> Column:
    """Length 1; zero vectors stay, null becomes empty."""
    n = norm(a)
    unit = F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.when(a.isNull(), F.array().cast("array<double>")).otherwise(unit)


def to_bytes(v: Column) -> Column:
    """A vector as its floats' four bytes each, the lowest first; null stays null."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())

    return run(v)


def from_bytes(b: Column) -> Column:
    """The vector of ``to_bytes``; null, or bytes that are no whole number of floats, give null."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None or len(a) % 4 else np.frombuffer(a, dtype="<f4"))

    return run(b)
