"""How memories are shown: the columns of a search result and of a memory's details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strength import current_strength


def search_result() -> list[Column]:
    """title, score, id, summary, tags of scored rows."""
    return [F.col("title"), F.format_string("%.2f", "score").alias("score"), F.col("id"), F.col("summary"), F.array_join("tags", ", ").alias("tags")]


def detail(now: Column) -> list[Column]:
    """title, id, summary, content, tags, created, strength of memories."""
    return [
        F.col("title"), F.col("id"), F.col("summary"), F.col("content"), F.array_join("tags", ", ").alias("tags"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.format_string("%.2f", current_strength(now)).alias("strength"),
    ]
