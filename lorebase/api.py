"""The engine's seven verbs over a store."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, EngineConfig
from .functions import report
from .functions.text import strip
from .operators import conflict
from .operators.embed import NullEmbedder, select_embedder
from .plans.scratch import dropped_after, written
from .schema import ACCESS, MEMORY
from .sources.store import MemoryStore, clamped, derived


class Engine:
    def __init__(self, spark: SparkSession, path: str, cfg: EngineConfig = DEFAULT, embedder=None):
        self.spark, self.cfg = spark, cfg
        self.store_ = MemoryStore(spark, path, cfg)
        self.embedder = embedder or NullEmbedder()
        self._verdicts = None

    def _vector(self, text: str):
        return self.embedder.embed(F.lit(text)) if self.embedder.available else None

    def search(self, query: str, now: datetime, top_n: int = 5, tags: list[str] | None = None, reinforce: bool = True) -> list:
        with dropped_after(self.spark):
            hits = self.store_.search(query, top_n, F.lit(now), tags, self._vector(query))
            return self.store_.search_and_reinforce(hits, now) if reinforce else hits.collect()

    def store(self, rows: DataFrame, now: datetime) -> DataFrame:
        """Store rows (title, summary, and optionally id, content, tags, importance, embedding, query_vector); their verdicts.

        Rows whose title or summary has only white space are an error.  A row is
        searched with the vector of its title and summary, and stored with the
        vector of its whole text.  Rows are stored as one by one in the order of
        their ids, in as few rounds as that takes; each round is a commit.
        """
        with dropped_after(self.spark) as kept:
            kept.append(self._stored(rows, now))
            return kept[0].drop("hits")

    def _stored(self, rows: DataFrame, now: datetime) -> DataFrame:
        given = set(rows.columns)
        blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
        if rows.where(blank(F.col("title")) | blank(F.col("summary"))).limit(1).count():
            raise ValueError("title and summary are required")
        full = clamped(self._filled(rows, now), self.cfg)
        query = F.col("query_vector") if "query_vector" in given else F.lit(None)
        if self.embedder.available:
            query = F.coalesce(query, self.embedder.embed(F.concat_ws(" ", "title", "summary")))
            whole = self.embedder.embed(F.concat_ws(" ", "title", "summary", "content"))
            full = full.withColumn("_query", query.cast("array<float>")).withColumn("embedding", F.coalesce("embedding", whole).cast("array<float>"))
        else:  # rows that bring their vectors
            full = full.withColumn("_query", F.coalesce(query.cast("array<float>"), F.col("embedding")))
        full = written(derived(full, self.cfg))  # ids are drawn once

        left, done = full, []
        single = full.limit(2).count() < 2

        def work(before):
            judged = left.withColumn("query_vector", F.col("_query"))
            verdicts = written(conflict.classify(before, judged, F.lit(now), self.cfg, self.store_.index().postings(), self.store_.fetch))
            if not single:
                verdicts = written(conflict.settled(judged, verdicts, F.lit(now), self.cfg))
            touched = verdicts.where("target is not null").select("target").union(conflict.supersede_edges(verdicts).select("old_id")).union(verdicts.select(F.explode("hits")))
            self._verdicts = verdicts
            some = written(before.join(touched.select(F.col("target").alias("id")).distinct(), "id", "left_semi"))
            rows = left.join(verdicts.select("id"), "id", "left_semi").select([f.name for f in MEMORY])
            return conflict.apply(some, rows, verdicts, F.lit(now), self.cfg)

        while True:  # a round for each link of the longest chain of rows that wait for one another
            self.store_.change(work)
            done.append(self._verdicts)
            if single:
                return done[0]
            left = written(left.join(self._verdicts.select("id"), "id", "left_anti"))
            if not left.limit(1).count():
                return done[0] if len(done) == 1 else written(reduce(DataFrame.unionByName, done))

    def _filled(self, rows: DataFrame, now: datetime) -> DataFrame:
        """All columns of a memory, with the values that are not given."""
        given = set(rows.columns)
        filled = {
            "id": F.uuid(), "content": F.lit(""), "tags": F.array().cast("array<string>"), "importance": F.lit(0.5), "created_at": F.lit(now), "last_accessed_at": F.lit(now),
            "base_strength": F.lit(1.0), "decay_rate": F.lit(0.1), "access_count": F.lit(0), "is_pinned": F.lit(False), "is_archived": F.lit(False), "valid_from": F.lit(now),
            "superseded_ids": F.array().cast("array<string>"), "linked_ids": F.array().cast("array<string>"),
        }
        value = lambda f: F.coalesce(f.name, filled[f.name]) if f.name in given and f.name in filled else F.col(f.name) if f.name in given else filled.get(f.name, F.lit(None))
        extra = ["query_vector"] if "query_vector" in given else []
        return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in MEMORY], *extra)

    def store_unlimited(self, rows: DataFrame, now: datetime) -> None:
        """Store rows as they are: no limits, no required fields, no search for conflicts (what a plain insert endpoint does)."""
        full = self._filled(rows, now)
        if self.embedder.available:
            full = full.withColumn("embedding", F.coalesce("embedding", self.embedder.embed(F.concat_ws(" ", "title", "summary", "content")).cast("array<float>")))
        self.store_.save(written(full))  # ids are drawn once

    @classmethod
    def open(cls, spark: SparkSession, path: str, settings: str = "{}", model_path: str | None = None, tokenizer_path: str | None = None) -> Engine:
        """An engine by its JSON settings, with the model if there is one and the vectors of hashed trigrams never: without a model, search is lexical."""
        cfg = EngineConfig.from_json(settings)
        return cls(spark, path, cfg, select_embedder(model_path, tokenizer_path, cfg.dimensions))

    def health(self, now: datetime) -> dict[str, str]:
        """That the store can be read, and when that was found."""
        try:
            self.store_.scan().limit(1).count()
            return {"status": "healthy", "timestamp": now.isoformat()}
        except Exception as e:  # noqa: BLE001  the answer is the report
            return {"status": "unhealthy", "timestamp": now.isoformat(), "error": str(e).split("\n")[0]}

    def search_report(self, query: str, now: datetime, top_n: int = 5, tags: list[str] | None = None) -> list:
        """The hits as they are shown; they are reinforced."""
        hits = self.search(query, now, top_n, tags)
        if not hits:
            return []
        place = {r.id: i for i, r in enumerate(hits)}
        shown = self.spark.createDataFrame([(r.title, r.score, r.id, r.summary, r.tags or []) for r in hits], "title string, score double, id string, summary string, tags array<string>")
        return sorted(shown.select(*report.search_result()).collect(), key=lambda r: place[r.id])

    def detail_report(self, key: str, now: datetime):
        """A memory's details as they are shown, or None; it is reinforced."""
        shown = self.store_.get(key).select(*report.detail(F.lit(now))).collect()
        if shown:
            self.store_.reinforce(self.spark.createDataFrame([(key, now)], ACCESS))
        return shown[0] if shown else None

    def update(self, rows: DataFrame) -> None:
        self.store_.update(rows)

    def get(self, key: str, now: datetime, reinforce: bool = True):
        found = self.store_.search_and_reinforce(self.store_.get(key), now) if reinforce else self.store_.get(key).collect()
        return found[0] if found else None

    def delete(self, ids: list[str]) -> int:
        return self.store_.delete(ids)

    def stats(self, now: datetime):
        return self.store_.stats(F.lit(now)).first()

    def stats_report(self, now: datetime) -> dict[str, str]:
        """The statistics as they are shown: N/A for the dates of an empty store, the size in MB."""
        s = self.stats(now)
        day = lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else "N/A"
        return {"total": str(s.total), "average_strength": f"{s.average_strength:.2f}", "weak": str(s.weak), "oldest": day(s.oldest), "newest": day(s.newest), "size": f"{self.store_.size_bytes() / 1048576:.2f} MB"}

    def close(self) -> None:
        self.store_.close()

    def tag_history(self, tag: str, now: datetime, include_archived: bool = True) -> DataFrame:
        return conflict.tag_history(self.store_.scan(), tag, F.lit(now), include_archived)

    def weak(self, threshold: float, now: datetime, limit: int = 100) -> DataFrame:
        return self.store_.weak(threshold, limit, F.lit(now))

    @staticmethod
    def new_id() -> str:
        return str(uuid.uuid4())
