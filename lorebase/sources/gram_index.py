"""The inverted index: postings of trigrams and tags, kept beside the commits of a store.

Each part of an index belongs to one commit and lies in four tables, clustered
by what they are asked for: postings of grams, postings of tags, numbers of
postings by gram and class, and bounds of the classes (see ``topk``).  Files are
cut by ranges and sorted inside, so a filter on a query's grams reaches the
Parquet statistics and reads only the row groups that can hold them.

A commit adds its own part and touches no other.  Postings of an id that a later
commit has written or deleted do not count: one join with the ids of the later
commits leaves them out.  Compaction leaves one commit, and so one part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import day_of
from ..functions.text import jaccard_of, normalize
from ..operators.search import Probe
from ..operators.topk import LEAN, Postings, best_by_postings, classes_of, posting_rows, sizes_of
from ..plans.scratch import written

_PARTS = ("grams", "tags", "sizes", "classes")


class GramIndex:
    """The parts of an index, oldest first; ``later`` has the ids (id, k) that the commits of the parts from the second on touch, and k may be no part's."""

    def __init__(self, spark: SparkSession, paths: list[str], later: DataFrame | None = None):
        self.spark, self.paths, self.later = spark, paths, later

    @classmethod
    def write(cls, memories: DataFrame, path: str) -> GramIndex:
        """The index of rows (id, trigrams, tags and what strength needs). A common gram's postings are cut into ranges of ids, so none is one task's."""
        spark = memories.sparkSession
        memories = written(memories.select(LEAN))  # read by each table, and by the samples of its ranges
        last = memories.agg(F.max("last_accessed_at").alias("t")).first().t
        at = F.coalesce(day_of(F.lit(last).cast("timestamp")), F.lit(0.0))
        rows, grams, tags = posting_rows(memories, at)
        grams.repartitionByRange("gram", "cls", "id").sortWithinPartitions("gram", "cls", "id").write.parquet(f"{path}/grams")
        tags.repartitionByRange("tag", "cls", "id").sortWithinPartitions("tag", "cls", "id").write.parquet(f"{path}/tags")
        sizes_of(spark.read.parquet(f"{path}/grams")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/sizes")
        classes_of(rows, at).coalesce(1).write.parquet(f"{path}/classes")  # the last: a part with it is complete
        return cls(spark, [path])

    def postings(self) -> Postings:
        """All parts together, without postings that later commits replace."""

        def table(name: str) -> DataFrame:
            parts = [self.spark.read.parquet(f"{p}/{name}").withColumn("_k", F.lit(k)) for k, p in enumerate(self.paths)]
            rows = reduce(DataFrame.unionByName, parts)
            if self.later is not None and "id" in rows.columns:
                rows = rows.join(self.later.select(F.col("id").alias("_id"), F.col("k").alias("_last")), (F.col("id") == F.col("_id")) & (F.col("_last") > F.col("_k")), "left_anti")
            return rows.drop("_k")

        return Postings(*(table(n) for n in _PARTS))

    def probe(self, query: str) -> DataFrame:
        """id, shared, fuzzy: the memories that share a gram with the query, how many, and the Jaccard similarity."""
        grams = self._query(query)[1]
        found = self.postings().grams.where(F.col("gram").isin(grams)).groupBy("id", "n").agg(F.count("*").cast("int").alias("shared"))
        return found.select("id", "shared", jaccard_of(F.col("shared"), F.lit(len(grams)), F.col("n")).alias("fuzzy"))

    def _query(self, query: str) -> tuple[DataFrame, list[str]]:
        """The query as a table of one row, and its grams."""
        one = written(self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query")).withColumns(Probe.columns(normalize(F.lit(query)))))
        return one, one.first()._grams

    def best(self, fetch, query: str | None, limit: int, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
        """id, _text_score: what ``search.text_search`` keeps of all memories.

        fetch: rows with an id, with the memories' columns.  Only postings of
        the query's grams are read, and only memories that the bounds let through.
        """
        one, grams = self._query(query or "")
        ix = self.postings()
        if len((query or "").strip()) >= 3:
            ix = ix.of_grams(grams)
        return best_by_postings(ix, fetch, one.where("_q <> ''"), limit, now, cfg).select("id", "_text_score")

    def text_search(self, df: DataFrame, query: str | None, limit: int, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
        """As ``search.text_search``, with ``df`` joined to the ids that are found."""
        hits = written(self.best(lambda found: df.join(found, "id"), query, limit, now, cfg))
        return df.join(hits, "id").orderBy(F.desc("_text_score"), "id")
