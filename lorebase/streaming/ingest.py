"""Structured Streaming: access logs counted by window, and memories stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import MemoryStore


def access_counts(accesses: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """id, day, n, last of a (streaming) access log (id, at); later rows than ``late`` are dropped by the watermark."""
    rows = accesses.withWatermark("at", late) if accesses.isStreaming else accesses
    per = rows.groupBy(F.window("at", every), "id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return per.select("id", F.col("window.start").alias("day"), "n", "last")


def _started(rows: DataFrame, apply, checkpoint: str, trigger: dict):
    """Each batch is applied with its number, under the name of its checkpoint, where the numbers count from: see ``MemoryStore._write``."""
    out = rows.writeStream.foreachBatch(lambda batch, number: apply(batch, (checkpoint, number))).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def store_stream(memories: DataFrame, store: MemoryStore, checkpoint: str, **trigger):
    """Save each arriving batch of memories; a started query. A batch that is run again is not stored again."""
    return _started(memories, store.save, checkpoint, trigger)


def reinforce_stream(accesses: DataFrame, store: MemoryStore, checkpoint: str, **trigger):
    """Apply each arriving batch of an access log (id, at); a started query. A batch that is run again reinforces nothing."""
    return _started(accesses, store.reinforce, checkpoint, trigger)
