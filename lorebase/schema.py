"""Schemas of the tables that the engine keeps and returns."""

from pyspark.sql import types as T

MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("last_accessed_at", T.TimestampType()),
        T.StructField("base_strength", T.DoubleType()),
        T.StructField("decay_rate", T.DoubleType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("access_count", T.IntegerType()),
        T.StructField("is_pinned", T.BooleanType()),
        T.StructField("is_archived", T.BooleanType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_until", T.TimestampType()),
        T.StructField("superseded_by", T.StringType()),
        T.StructField("superseded_ids", T.ArrayType(T.StringType())),
        T.StructField("linked_ids", T.ArrayType(T.StringType())),
        T.StructField("expires_at", T.TimestampType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("content_normalized", T.StringType()),
        T.StructField("trigrams", T.ArrayType(T.StringType())),
        T.StructField("prune_day", T.DoubleType()),
        T.StructField("weak_day", T.DoubleType()),
    ]
)

ACCESS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("at", T.TimestampType(), False)])
