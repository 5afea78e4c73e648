"""What the operators share: scratch tables, batches of texts, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts go through Python in pieces of about so many bytes.
CHUNK_BYTES = 2 << 20
#: Makes Spark delete an execution's shuffle files at its end, and not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Intermediate tables in the folder that spark.checkpoint.dir names.

    A written table cuts lineage and survives the loss of executors.  Where
    that setting is absent (tests, a laptop) a temporary folder is used and
    removed when Python ends.
    """

    _own: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if Scratch._own is None:
                Scratch._own = tempfile.mkdtemp(prefix="lorebase-")
                atexit.register(shutil.rmtree, Scratch._own, ignore_errors=True)
            root = Scratch._own
        self.root = f"{root.rstrip('/')}/lorebase-{uuid.uuid4().hex}"
        self._n = 0
        self._live: list[DataFrame] = []

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; ``table.path`` on the result is where it lies.

        Nothing reads the shuffle files of a written table, so they go at once.
        """
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_UP)
            else:
                self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        self._live.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no pending plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.path)
            p.getFileSystem(conf).delete(p, True)
        gone = {t.path for t in tables}
        self._live = [t for t in self._live if t.path not in gone]

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these: what an operator's lazy result still reads."""
        kept = {t.path for t in tables}
        self.drop(*[t for t in self._live if t.path not in kept])


def slices(batches, column: str, limit: int = CHUNK_BYTES):
    """Cut Arrow batches so that each has about ``limit`` bytes in ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        sizes = pa.compute.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of an id's decimal text; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string"))
