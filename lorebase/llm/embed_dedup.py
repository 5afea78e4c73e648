"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Equal vectors are one class.  Centres come from a bounded sample; every class
belongs to its nearest centre's cell.  A pair can be up to ``acos(threshold)``
apart and lie on both sides of a border between cells, so a class also asks
the cells across all borders that it is that near to: with unit centres c and
d, home c, a partner in cell d implies ``x . (c - d) <= |c - d| * sin(angle)``.
That makes the cells exact: no linked pair is missed, whatever the centres.

In a cell, blocks of members meet blocks of askers in one matrix product each
(single precision, what comes near the threshold again in double).  Vectors
travel as the bytes they are stored in.  A block
pair gives one count per asker and a spanning forest of its links, never the
pairs, so a group of close vectors costs rows in its size.

Null and zero vectors and vectors with null or non-finite components link with
nothing; vectors only link with vectors of their own length.  Ties and repeated vec_ids need no rule:
each row gets its class's result; a null vec_id counts as a neighbour but is a
component_id only where all ids are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .ngram_join import runs_of

THRESHOLD = 0.95
#: Vectors that centres are fitted on, at most; rows of a block; centres, at most.
SAMPLE, BLOCK, CENTRES = 20_000, 8192, 1024
#: Vectors for each centre, about; centres, at least, where there are so many vectors.
PER_CELL, LEAST_CENTRES = 8192, 8
#: Rows that one batch of placed vectors has, about.
PLACED_ROWS = 65_536
#: The rows of a component's hot key are spread over so many.
SALTS = 16


#: op4 in SQL: all pairs, in double precision.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id
"""


def _rows(column: pa.Array, kind: str) -> list[np.ndarray | None]:
    """Each row's vector, or None if it links with nothing."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)  # null components become NaN
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for a, b, none in zip(offsets[:-1], offsets[1:], missing):
        x = values[a:b]
        out.append(None if none or not np.isfinite(x).all() or not x.any() else x + 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x in double precision with length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length, from their bytes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def kind_of(rows: DataFrame) -> str:
    """How vectors travel: as float32 where they are stored so."""
    return "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def vector_classes(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id, key (null: links with nothing), raw (the vector's bytes) of every row."""

    def run(batches):
        for b in batches:
            raw = [None if x is None else x.tobytes() for x in _rows(b.column(1), kind)]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, type=pa.binary()), pa.array(raw, type=pa.binary())], names=["vec_id", "key", "raw"])

    element = "float" if kind == "<f4" else "double"
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, key binary, raw binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of the unit rows of x."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return np.unique(c, axis=0)


def centres_of(classes: DataFrame, n: int, kind: str, cells: int | None = None) -> dict[int, np.ndarray]:
    """For each length of vectors in bytes, its centres (``cells`` if given); fitted on at most SAMPLE classes, taken by least key."""
    rows = classes.orderBy("key").limit(SAMPLE).select("raw").toArrow().column(0).to_pylist()
    out = {}
    for d in {len(r) for r in rows}:
        x = _unit(np.array([np.frombuffer(r, dtype=kind) for r in rows if len(r) == d]))
        k = int(min(cells or min(CENTRES, max(LEAST_CENTRES, n * len(x) / len(rows) / PER_CELL)), len(x)))
        out[d] = spherical_kmeans(x, k)
    return out


def placed(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float, kind: str) -> DataFrame:
    """cell, home, key, weight, raw: every class in its own cell (home) and in those that it asks."""
    held = classes.sparkSession.sparkContext.broadcast(centres)
    sine = float(np.sqrt(1 - threshold**2)) + 1e-6

    def run(batches):
        for b in batches:
            lens = pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False)
            for d in np.unique(lens).tolist():
                at = np.flatnonzero(lens == d)
                c = held.value.get(d, np.zeros((1, d // int(kind[2]))))
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                step = max(1, PLACED_ROWS // len(c))
                for i in range(0, len(at), step):
                    part = b.take(pa.array(at[i : i + step]))
                    x = _unit(_stack(part.column(2), kind))
                    dots = x @ c.T
                    own = np.argmax(dots, axis=1)
                    near = dots[np.arange(len(x)), own][:, None] - dots <= apart[own] * sine
                    near[np.arange(len(x)), own] = True
                    row, cell = np.nonzero(near)
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{i}" for i in cell]), pa.array(cell == own[row]), *out.columns], names=["cell", "home", "key", "weight", "raw"])

    return classes.select("key", "weight", "raw").mapInArrow(run, "cell string, home boolean, key binary, weight long, raw binary")


def cell_links(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """key, links (weights of linked members), to (the root of a spanning forest) of askers and members in each (cell, block)."""

    def run(batches):
        for _, t in runs_of(batches, ["cell", "block"]):
            member = np.array(t.column("member").to_pylist())
            keys = t.column("key").to_pylist()
            weight = np.array(t.column("weight").to_pylist(), dtype=np.int64)
            x = _unit(_stack(t.column("raw"), kind))
            m, a = np.flatnonzero(member), np.flatnonzero(~member)
            if not len(m) or not len(a):
                continue
            number: dict[bytes, int] = {}
            node = np.array([number.setdefault(k, len(number)) for k in keys])
            names, root = list(number), np.arange(len(number))
            links = np.zeros(len(a), dtype=np.int64)
            xm = x[m].astype(np.float32).T
            for lo in range(0, len(a), 256):
                rows = a[lo : lo + 256]
                cos = x[rows].astype(np.float32) @ xm
                some = np.flatnonzero(cos.max(axis=1) >= threshold - 1e-4)
                if not len(some):
                    continue
                cos, rows = cos[some], rows[some]
                hit = cos >= threshold + 1e-4
                r, c = np.nonzero(~hit & (cos >= threshold - 1e-4))
                for f in range(0, len(r), 65_536):
                    g = slice(f, f + 65_536)
                    hit[r[g], c[g]] = np.einsum("ij,ij->i", x[rows[r[g]]], x[m[c[g]]]) >= threshold
                hit &= node[rows][:, None] != node[m]
                links[lo + some] = hit @ weight[m]
                for i in np.flatnonzero(hit.any(axis=1)):
                    met = np.unique(root[np.append(node[m[hit[i]]], node[rows[i]])])
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
            out = [(keys[a[i]], int(links[i]), None) for i in np.flatnonzero(links)]
            out += [(names[i], 0, names[root[i]]) for i in np.flatnonzero(root != np.arange(len(root)))]
            if not out:
                continue
            k, n, to = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(to, type=pa.binary())], names=["key", "links", "to"])

    parts = rows.repartition("cell", "block").sortWithinPartitions("cell", "block")
    return parts.mapInArrow(run, "key binary, links long, to binary")


def near_copies(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding); ``cells`` centres, if given."""
    s = Scratch(rows.sparkSession)
    kind = kind_of(rows)
    every = s.save(vector_classes(rows, kind))
    classes = every.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("raw").alias("raw"))
    classes = s.save(classes)
    here = s.save(placed(classes, centres_of(classes, classes.count(), kind, cells), threshold, kind))
    sizes = here.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("members"), F.count("*").alias("askers"))
    sizes = s.save(sizes.where("members > 0").select("cell", F.ceil(F.col("members") / block).alias("bm"), F.ceil(F.col("askers") / block).alias("ba")))
    both = here.join(sizes, "cell")
    every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    m = both.where("home").withColumn("x", F.pmod(F.xxhash64("key"), F.col("bm"))).withColumn("y", every_block(F.col("ba")))
    a = both.withColumn("y", F.pmod(F.xxhash64("key"), F.col("ba"))).withColumn("x", every_block(F.col("bm")))
    cols = ["cell", (F.col("x") * (1 << 31) + F.col("y")).alias("block"), "key", "weight", "raw"]
    pairs = m.select(*cols, F.lit(True).alias("member")).unionByName(a.select(*cols, F.lit(False).alias("member")))
    found = s.save(cell_links(pairs, threshold, kind))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b")), s)
    state = classes.select("key", "weight", "least").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")
    state = s.save(state.select("key", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"), salt))
    # a component may have a large share of all classes, so its key is salted
    least = state.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")).where("many > 1")
    least = least.select("root", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    state = s.save(state.join(least, ["root", "salt"], "left").select("key", "n_links", F.coalesce("component_id", "least").alias("component_id")))
    s.keep_only(every, state)
    out = every.select("vec_id", "key").join(state, "key", "left")
    comp = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(False)).alias("kept"))
