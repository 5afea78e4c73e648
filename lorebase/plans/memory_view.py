"""The driver's tables seen as memories (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strength import reinforced
from ..functions.text import searchable, trigrams

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, at) of the views and clicks."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))


def memories(spark: SparkSession, sf_dir: str, accessed: bool = True) -> DataFrame:
    """All documents as memories; without ``accessed``, as before the access log."""
    d = table(spark, sf_dir, "documents")
    files, cores = len(d.inputFiles()), spark.sparkContext.defaultParallelism
    d = d.select(F.col("doc_id").alias("id"), "text", "lang", "source")
    if files < cores:  # a small table in few files would be one task's work
        d = d.repartition(cores, "id")
    flatten = lambda c: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(200))
    # before the joins, which so move no whole texts where content is not read; mostly the beginning of a text has the characters that are wanted; if not, the whole text is read
    begin = flatten(F.left("text", F.lit(400)))
    d = d.withColumn("flat", F.when(F.length(begin) == 200, begin).otherwise(flatten(F.col("text"))))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    m = d.join(labels, "id", "left").join(vectors, "id", "left")
    tags = F.array_compact(F.array("lang", "source", F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    start = F.timestamp_micros(F.unix_micros(F.lit("2023-12-01").cast("timestamp")) + (F.col("id") % 60) * 86_400_000_000 + (F.col("id") % 1440) * 60_000_000)
    archived = F.col("id") % 13 == 5
    m = m.select(
        "id", F.left("flat", F.lit(60)).alias("title"), F.col("flat").alias("summary"), F.left("text", F.lit(524_288)).alias("content"), tags.alias("tags"),
        start.alias("created_at"), start.alias("valid_from"), start.alias("last_accessed_at"), F.lit(1.0).alias("base_strength"), F.lit(0.1).alias("decay_rate"),
        ((F.col("id") % 11) / 10.0).alias("importance"), F.lit(0).alias("access_count"), (F.col("id") % 97 == 0).alias("is_pinned"), archived.alias("is_archived"),
        F.when(archived & (F.col("id") % 2 != 0), start + F.expr("interval 1 day")).alias("valid_until"),
        F.when(F.col("id") % 17 == 3, now() - F.expr("interval 1 day")).alias("expires_at"), "embedding",
    )
    ids = d.select((F.col("id") - 1).alias("id"), F.col("id").alias("next"))
    m = m.join(ids, "id", "left").withColumn("superseded_by", F.when(F.col("is_archived"), F.col("next"))).drop("next")
    m = m.withColumn("content_normalized", searchable(F.col("title"), F.col("summary"), F.col("tags"))).withColumn("trigrams", trigrams(F.col("content_normalized")))
    if not accessed:
        return m
    per = access_log(spark, sf_dir).groupBy("id").agg(F.count("*").cast("int").alias("_n"), F.max("at").alias("_at"))
    m = m.join(per, "id", "left")
    n = F.coalesce("_n", F.lit(0))
    m = m.withColumn("base_strength", reinforced(F.lit(1.0), F.lit(0), n)).withColumn("access_count", n)
    return m.withColumn("last_accessed_at", F.coalesce("_at", "last_accessed_at")).drop("_n", "_at")
