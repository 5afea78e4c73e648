"""The memory store: an append-only Parquet log with manifests, and its current view.

Each commit is a directory of rows with a version and an operation (U or D).
A manifest lists the committed directories.  Manifests are numbered and never
replaced: a new one is written beside the others and then renamed to its
number, and the newest is the state of the store.  A crash at any point leaves
the last complete manifest in force, and readers always find one.

Writes read, compute and commit under a lock; a writer in another process that
took the number first makes the commit fail, and the write starts again from
the newer state.  What compaction replaces stays for GRACE seconds, for readers
that still hold it; see ``vacuum``.  All file access goes through the file
system of the path, local or not.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import below, crossing_day, current_strength, reinforced
from ..functions.text import searchable, trigrams, without_orphans
from ..operators import maintain
from ..operators.search import Probe, second_stage, weak
from ..plans.scratch import folder, written
from ..schema import ACCESS, MEMORY
from .gram_index import GramIndex


def derived(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Index text, trigrams and the days from which on a memory is weak or to be pruned, as every write computes them."""
    df = df.withColumn("content_normalized", searchable(F.col("title"), F.col("summary"), F.col("tags"), cfg.index_chars))
    df = df.withColumn("trigrams", trigrams(F.col("content_normalized")))
    return df.withColumn("prune_day", crossing_day(cfg.prune_threshold)).withColumn("weak_day", crossing_day(cfg.weak_threshold))


def clamped(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Inputs cut to their limits, importance to 0 to 1."""
    out = df.withColumn("title", F.left("title", F.lit(cfg.max_title))).withColumn("summary", F.left("summary", F.lit(cfg.max_summary)))
    out = out.withColumn("content", F.left("content", F.lit(cfg.max_content))).withColumn("tags", F.slice("tags", 1, cfg.max_tags))
    return out.withColumn("importance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "importance")))


def merged(df: DataFrame, updates: DataFrame) -> DataFrame:
    """``df`` with the columns that ``updates`` (id, ...) has a value for; unknown ids are appended."""
    cols = [c for c in updates.columns if c != "id"]
    u = updates.select("id", *[F.col(c).alias(f"_u_{c}") for c in cols])
    both = df.join(u, "id", "full_outer")
    return both.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def latest(log: DataFrame) -> DataFrame:
    """The rows of a log (id, version, op, ...) as they are now."""
    by = Window.partitionBy("id").orderBy(F.desc("version"))
    return log.withColumn("_r", F.row_number().over(by)).where("_r = 1 and op <> 'D'").drop("_r", "version", "op")


def reinforce(df: DataFrame, accesses: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``df`` after an access log (id, at); accesses of archived memories are ignored."""
    per = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    rows = df.join(per, "id", "left")
    hit = F.col("_n").isNotNull() & ~F.col("is_archived")
    rows = rows.withColumn("base_strength", F.when(hit, reinforced(F.col("base_strength"), F.col("access_count"), F.col("_n"), cfg.reinforcement)).otherwise(F.col("base_strength")))
    rows = rows.withColumn("last_accessed_at", F.when(hit, F.col("_at")).otherwise(F.col("last_accessed_at")))
    rows = rows.withColumn("access_count", F.when(hit, F.col("access_count") + F.col("_n")).otherwise(F.col("access_count")).cast("int"))
    return rows.select(df.columns)


def stats(df: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: number, average strength, weak ones, first and last creation."""
    s = current_strength(now)
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("average_strength"),
        F.count_if(s < cfg.weak_threshold).alias("weak"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


#: Seconds that replaced commits stay for lazy readers.
GRACE = 3600
_NUMBERED = re.compile(r"manifest-(\d{12})\.json")


#: Up to so many ids are looked up by a filter.
LOOKUP = 256


class Conflict(Exception):
    """Another writer committed first."""


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, cfg: EngineConfig = DEFAULT, grace: float = GRACE):
        self.spark, self.path, self.cfg, self.grace = spark, path.rstrip("/"), cfg, grace
        self._lock = threading.RLock()
        self._fs, self._at = self._open(self.path)
        self._fs.mkdirs(self._at)
        self.running: str | None = None
        self.closed = False

    def __enter__(self) -> MemoryStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """No writes from here on; drops what grace no longer protects. The session stays with its owner."""
        if not self.closed:
            self.vacuum()
            self.closed = True

    def _open(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _child(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _numbers(self) -> list[int]:
        """The versions of all manifests, the newest first."""
        found = (_NUMBERED.fullmatch(f.getPath().getName()) for f in self._fs.listStatus(self._at))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _read(self, version: int) -> dict | None:
        """A manifest; None if it is incomplete or gone."""
        try:
            stream = self._fs.open(self._child(f"manifest-{version:012d}.json"))
        except Exception:  # noqa: BLE001  vacuumed between the listing and now
            return None
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _manifest(self) -> dict:
        for version in self._numbers():
            if (m := self._read(version)) is not None:
                return m
        return {"version": 0, "commits": [], "last_run": {}}

    def _publish(self, manifest: dict) -> None:
        new, at = self._child(f"new-{uuid.uuid4().hex}"), self._child(f"manifest-{manifest['version']:012d}.json")
        stream = self._fs.create(new, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        jvm = self.spark.sparkContext._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # fails if the number is taken
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, at, how)
        except Exception as e:  # noqa: BLE001
            self._fs.delete(new, False)
            if self._fs.exists(at):
                raise Conflict(str(manifest["version"])) from e
            raise

    def _write(self, work, attempts: int = 20, once: tuple[str, int] | None = None):
        """Run ``work(rows, manifest)`` -> (result, rows to commit or None, op, replace) and commit, again if another writer was first.

        ``once``: a stream and the number of its batch. The manifest of the
        commit says so, and a batch that it has is not done again.
        """
        if self.closed:
            raise ValueError("the store is closed")
        with self._lock:
            for _ in range(attempts):
                m = self._manifest()
                if once and m.get("ledger", {}).get(once[0], -1) >= once[1]:
                    return None
                result, rows, op, replace = work(self._view(m), m)
                if rows is None:
                    return result
                try:
                    self._commit(m, rows, op, replace, once)
                    return result
                except Conflict:
                    continue
            raise Conflict(f"no commit in {attempts} attempts")

    def _commit(self, m: dict, rows: DataFrame, op: str, replace: bool, once: tuple[str, int] | None = None) -> None:
        name, version = f"commit-{uuid.uuid4().hex}", m["version"] + 1
        if replace:  # clustered by the month in which memories fade, then by id, for ranges and look-ups
            order = [F.floor(F.col("prune_day") / 30), F.col("id")]
            # index text and trigrams are computed behind the shuffles, as for every write: they are half of a row's bytes
            rows = self._whole(rows.drop("content_normalized", "trigrams").repartitionByRange(*order).sortWithinPartitions(*order))
        rows.withColumn("version", F.lit(version)).withColumn("op", F.lit(op)).write.parquet(f"{self.path}/{name}")
        last = dict(m.get("last_run", {}))
        if self.running:
            last[self.running] = datetime.now(timezone.utc).isoformat()
        ledger = m.get("ledger", {}) | (dict([once]) if once else {})
        # what replaces everything is the view of everything: one row for each id
        base = name if replace else m.get("base")
        self._publish({"version": version, "commits": [name] if replace else [*m["commits"], name], "base": base, "last_run": last, "ledger": ledger})

    def vacuum(self, grace: float | None = None) -> int:
        """Delete commits and manifests that the current manifest has replaced and that are older than ``grace`` seconds; how many."""
        before = (time.time() - (self.grace if grace is None else grace)) * 1000
        with self._lock:
            m, gone = self._manifest(), 0
            live = {*m["commits"], *(f"index-{c}" for c in m["commits"])}
            for f in self._fs.listStatus(self._at):
                name = f.getPath().getName()
                number = _NUMBERED.fullmatch(name)
                old = int(number[1]) < m["version"] if number else name not in live
                if old and f.getModificationTime() <= before:
                    gone += bool(self._fs.delete(f.getPath(), True))
            return gone

    def _view(self, m: dict) -> DataFrame:
        if not m["commits"]:
            return self.spark.createDataFrame([], MEMORY)
        names, base = m["commits"], m.get("base")
        if base != names[0]:
            return latest(self._commits(names))
        # rows of a base are one for each id: only what came after it is compared by version
        rows = self._commits([base]).drop("version", "op")
        if len(names) == 1:
            return rows
        log = self._commits(names[1:])
        return rows.join(log.select("id").distinct(), "id", "left_anti").unionByName(latest(log))

    def _commits(self, names: list[str]) -> DataFrame:
        """All rows of commits, with version and op."""
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in MEMORY)}, version int, op string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{c}" for c in names])

    def scan(self) -> DataFrame:
        """All memories, archived ones too."""
        return self._view(self._manifest())

    def get(self, key: str) -> DataFrame:
        return self.scan().where(F.col("id") == key).limit(1)

    def _whole(self, rows: DataFrame) -> DataFrame:
        """All columns of a memory, index columns computed."""
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY])
        return derived(rows, self.cfg)

    def save(self, rows: DataFrame, once: tuple[str, int] | None = None) -> None:
        """Insert or replace whole rows; index columns are computed."""
        rows = self._whole(rows)
        self._write(lambda now, m: (None, rows, "U", False), once=once)

    def save_python(self, rows: list[dict]) -> None:
        """Save rows given as Python values; unpaired surrogates, which Spark strings cannot hold, are dropped first."""
        clean = lambda v: without_orphans(v) if isinstance(v, str) else [clean(x) for x in v] if isinstance(v, list) else v
        names = [f.name for f in MEMORY]
        self.save(self.spark.createDataFrame([tuple(clean(r.get(n)) for n in names) for r in rows], MEMORY))

    def change(self, work, once: tuple[str, int] | None = None) -> None:
        """Save ``work(current rows)``, computed from the state that the commit follows."""
        self._write(lambda now, m: (None, written(self._whole(work(now))), "U", False), once=once)

    def update(self, updates: DataFrame) -> None:
        """Set the given columns of existing memories; null leaves a value as it is."""
        self.change(lambda now: merged(now.join(updates.select("id"), "id", "left_semi"), updates.join(now.select("id"), "id", "left_semi")))

    def delete(self, ids: list[str]) -> int:
        """Delete by id; how many there were."""

        def work(now, m):
            rows = written(now.where(F.col("id").isin(ids)))
            n = rows.count()
            return n, rows if n else None, "D", False

        return self._write(work)

    def reinforce(self, accesses: DataFrame, once: tuple[str, int] | None = None) -> None:
        """Apply an access log (id, at) once; ``once``: see ``_write``."""
        self.change(lambda now: reinforce(now.join(accesses.select("id").distinct(), "id", "left_semi"), accesses, self.cfg), once)

    def search_and_reinforce(self, hits: DataFrame, now) -> list:
        """The rows of ``hits`` as they were; each is then reinforced at ``now`` (a datetime)."""
        rows = hits.collect()  # at most top_n
        if rows:
            self.reinforce(self.spark.createDataFrame([(r.id, now) for r in rows], ACCESS))
        return rows

    def index(self) -> GramIndex:
        """The inverted index of the current state; each commit's part is written once, when it is first asked for."""
        m, paths, later = self._manifest(), [], []
        for k, name in enumerate(m["commits"]):
            rows = self._commits([name])
            if k:
                later.append(rows.select("id", F.lit(len(paths)).alias("k")))
            at = self._child(f"index-{name}")
            if not self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "classes/_SUCCESS")):
                new = f"index-new-{uuid.uuid4().hex}"
                GramIndex.write(rows.where("op <> 'D'"), f"{self.path}/{new}")
                if not self._fs.rename(self._child(new), at):  # another reader was first
                    self._fs.delete(self._child(new), True)
            paths.append(f"{self.path}/index-{name}")
        if not paths:
            paths = [folder(self.spark, "index")]
            GramIndex.write(self._view(m), paths[0])
        return GramIndex(self.spark, paths, reduce(DataFrame.unionAll, later).groupBy("id").agg(F.max("k").alias("k")) if later else None)

    def fetch(self, found: DataFrame) -> DataFrame:
        """``found`` (id, ...) with the memories' columns.

        A few ids are a filter that reaches the files, and only the versions of
        the ids asked for are compared.
        """
        commits = self._manifest()["commits"]
        if not commits:
            return self.scan().join(found, "id")
        log = self._commits(commits)
        few = [r.id for r in found.select("id").distinct().limit(LOOKUP + 1).collect()]
        log = log.where(F.col("id").isin(few)) if len(few) <= LOOKUP else log.join(found.select("id").distinct(), "id", "left_semi")
        return latest(log).join(found, "id")

    def search(self, query: str | None, top_n: int, now: Column, tags: list[str] | None = None, vector: Column | None = None) -> DataFrame:
        """``search.search`` over the current state, by the index."""
        hits = written(self.index().best(self.fetch, query, self.cfg.over_fetch * top_n, now, self.cfg))
        return second_stage(self.fetch(hits), Probe.literal(self.spark, query or ""), top_n, now, tags, vector, self.cfg)

    def stats(self, now: Column) -> DataFrame:
        return stats(self.scan(), now, self.cfg)

    def weak(self, threshold: float, limit: int, now: Column) -> DataFrame:
        """``search.weak`` over the current state; up to the threshold that memories are weak from, by the stored day."""
        rows = self.scan()
        if threshold <= self.cfg.weak_threshold:
            rows = rows.where(below(threshold, now, "weak_day"))
        return weak(rows, threshold, limit, now)

    def size_bytes(self) -> int:
        """Bytes of the committed files; 0 if they cannot be read."""
        try:
            return sum(self._fs.getContentSummary(self._child(c)).getLength() for c in self._manifest()["commits"])
        except Exception:  # noqa: BLE001  an unreadable store has no size
            return 0

    def _alone(self, name: str, work) -> dict:
        """Run one maintenance task; a busy store answers instead of waiting."""
        if not self._lock.acquire(blocking=False):
            return {"success": False, "error": "another operation is running"}
        try:
            if self.running:  # the lock admits its own thread again
                return {"success": False, "error": "another operation is running"}
            self.running = name
            return {"success": True, **self._write(work)}
        finally:
            if self.running == name:
                self.running = None
            self._lock.release()

    def compact(self) -> dict:
        """Rewrite the current rows as one commit."""
        before = self.size_bytes()
        done = self._alone("compact", lambda now, m: ({}, now, "U", True))  # the view reads commits only, and ``_commit`` shuffles it once
        if done["success"]:
            after = self.size_bytes()
            self.vacuum()
            done |= {"before": before, "after": after, "saved_percent": maintain.saved_percent(before, after)}
        return done

    def prune(self, now: Column) -> dict:
        def work(rows, m):
            report = maintain.decay_report(rows, now, self.cfg).first().asDict()
            gone = rows.where(below(self.cfg.prune_threshold, now, "prune_day"))
            return report, written(gone) if report["pruned"] else None, "D", False

        return self._alone("prune", work)

    def consolidate(self, now: Column, use_vectors: bool = True) -> dict:
        """Merge similar memories, by text and vectors where both have one."""

        def work(rows, m):
            plan = written(maintain.consolidate(rows, now, self.cfg, use_vectors))
            counts = plan.agg(F.count_distinct("cluster").alias("merged"), F.count_if(F.col("action") == "archive").alias("archived")).first().asDict()
            changed = maintain.apply_consolidation(rows.join(plan.select("id"), "id", "left_semi"), plan, now, self.cfg)
            return counts, written(changed) if counts["merged"] else None, "U", False

        return self._alone("consolidate", work)

    def reindex(self, embedder=None) -> dict:
        def work(rows, m):
            rows = written(maintain.reindex(rows, embedder))
            return maintain.reindex_report(rows).first().asDict(), rows, "U", True

        return self._alone("reindex", work)

    def status(self) -> dict:
        return {"running": self.running is not None, "operation": self.running, "last_run": dict(self._manifest().get("last_run", {}))}
