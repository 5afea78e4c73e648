"""Written intermediate tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this set, Spark deletes what a query has shuffled at the query's end.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: str | None = None
_made: list[str] = []
_spans = threading.local()


def root(spark: SparkSession) -> str:
    global _own
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lorebase-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def folder(spark: SparkSession, kind: str) -> str:
    """A new path for a table or store of this process; ``clear`` deletes it."""
    path = f"{root(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    for span in getattr(_spans, "open", []):
        span.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> int:
    """Delete all that this process has written here; for the end of a job, when no result is read any more."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Delete a written table that is not read any more, before its time."""
    if table.path in _made:
        _made.remove(table.path)
        _delete(spark, table.path)


@contextmanager
def dropped_after(spark: SparkSession):
    """What this thread writes inside is deleted at the end, but for the tables added to the list that is given: results that are still read."""
    span, kept = [], []
    _spans.open = [*getattr(_spans, "open", []), span]
    try:
        yield kept
    finally:
        _spans.open = _spans.open[:-1]
        for path in span:
            if path in _made and path not in {getattr(t, "path", None) for t in kept}:
                _made.remove(path)
                _delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read again: short lineage that survives the loss of executors.

    Files shuffled for it are deleted at once, not when the driver happens to collect its garbage.
    """
    path, conf = folder(df.sparkSession, "plan"), df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out
