"""An exact join of vectors by cosine, in cells around pivots.

Each vector belongs to the cell of the pivot that it is most like.  Vectors of
cosine ``c`` are at most ``sqrt(2 - 2c)`` apart when scaled to length 1, so a
vector need only ask the cells whose border is no farther away than that: a
pair is met once, where one of the two asks the cell of the other.  Pivots are a
bounded sample, which decides how much work is saved, never what is found.

Cells, two by two, are one group each: of two cells one asks the other, so what
is sent is half of what all would ask.  There the vectors are multiplied in blocks,
in single precision; what comes near the bound is computed again in double.
Groups take turns, so that the disk of one shuffle is bounded.
There are only as many cells as give each one block, for every vector may have
to ask half of them; full cells and askers are cut by salts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, l2_normalized, norm
from ..plans.scratch import written

#: Pivots, at most: what is broadcast is bounded.
MAX_PIVOTS = 512
#: Vectors of a cell that share a salt; a pivot for so many.
BLOCK = 8192
#: Blocks of askers that share a salt, and rows of one product.
ASKERS, CHUNK = 4, 2048
#: Rows that are sent for one shuffle, roughly.
SENT_AT_ONCE = 4_000_000
#: What single precision may be off by, for vectors of length 1.
SLACK = 1e-4


def _pivots(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    """Distinct vectors of a length, by the hash of their ids."""
    count = min(MAX_PIVOTS, max(1, n // BLOCK))
    found = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("unit").limit(count).collect()
    return np.unique(np.array([r.unit for r in found]), axis=0)


def _met(askers: pd.DataFrame, members: pd.DataFrame, least: float, may=None) -> pd.DataFrame:
    """(x, y, same): askers and members of one group whose cosine is at least ``least``, and that ``may``, if given, admits."""
    xs, ys, same = [], [], []
    if len(askers) and len(members):
        a, b = np.stack(askers["unit"].to_numpy()), np.stack(members["unit"].to_numpy())
        b32 = b.astype(np.float32).T
        for k in range(0, len(a), CHUNK):
            i, j = np.nonzero(a[k : k + CHUNK].astype(np.float32) @ b32 >= least - SLACK)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)] + k, j[at : at + (1 << 16)]
                if may is not None:
                    admitted = may(askers, p, members, q)
                    p, q = p[admitted], q[admitted]
                near = np.einsum("ij,ij->i", a[p], b[q]) >= least - 1e-9
                xs.append(askers["id"].to_numpy()[p[near]])
                ys.append(members["id"].to_numpy()[q[near]])
                same.append(askers["own"].to_numpy()[p[near]] == members["cell"].to_numpy()[q[near]])
    join = lambda parts, of: np.concatenate(parts) if parts else of.to_numpy()[:0]
    return pd.DataFrame({"x": join(xs, askers["id"]), "y": join(ys, members["id"]), "same": np.concatenate(same) if same else np.zeros(0, bool)})


def near_vectors(rows: DataFrame, least: float, also=None, may=None) -> DataFrame:
    """(a, b) of rows (id, embedding, ...), a < b, whose vectors have a cosine of at least ``least`` > 0.

    also(a, b): a condition on the further columns of rows aliased so, which
    pairs must meet besides; the vectors are tested first.  may(one, p, other, q):
    such a test in the products, of rows p and q of two frames with the further
    columns, before pairs leave them.  Null, empty and zero vectors, and vectors of different lengths, are near nothing;
    ids are unique.
    """
    if not 0 < least:
        raise ValueError("vectors without a common direction need another join")
    size = norm(F.col("embedding"))
    carried = [] if may is None else [c for c in rows.columns if c not in ("id", "embedding")]
    known = rows.where((F.size("embedding") > 0) & (size > 0)).withColumn("unit", l2_normalized(F.col("embedding"))).withColumn("dim", F.size("embedding")).drop("embedding")
    known = written(known)
    dims = known.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return known.select(F.col("id").alias("a"), F.col("id").alias("b"))
    pivots = _pivots(known, dims[0]["dim"], dims[0]["count"])
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    table = rows.sparkSession.createDataFrame([(pivots.tolist(), apart.tolist())], "pivots array<array<double>>, apart array<array<double>>")
    reach = math.sqrt(max(0.0, 2 - 2 * min(least, 1.0))) + 1e-9
    usual = F.col("dim") == dims[0]["dim"]
    at = known.crossJoin(F.broadcast(table))  # one row of at most MAX_PIVOTS vectors and their distances
    at = at.withColumn("dots", F.when(usual, F.transform("pivots", lambda p: dot(p, F.col("unit")))))
    at = at.withColumn("own", (F.array_position("dots", F.array_max("dots")) - 1).cast("int"))
    border = F.get("apart", F.col("own"))
    within = lambda i: F.get("dots", F.col("own")) - F.get("dots", i) <= reach * F.get(border, i) + 1e-9
    asks = F.when(usual, F.filter(F.sequence(F.lit(0), F.lit(len(pivots) - 1)), within)).otherwise(F.array(-F.col("dim")))
    # vectors of an unusual length have one cell for each length
    at = at.withColumn("asks", asks).withColumn("own", F.coalesce("own", -F.col("dim"))).select("id", "unit", "own", "asks", *carried)
    at = written(at)
    n = len(pivots)
    # of two cells the one asks that is at most half the round before the other; two that face each other, the lesser
    ahead = lambda i: F.pmod(i - F.col("own"), F.lit(n))
    asked = F.filter("asks", lambda i: (i < 0) | (2 * ahead(i) < n) | ((2 * ahead(i) == n) & (F.col("own") < i)))
    salts = F.broadcast(at.groupBy("own").agg(F.ceil(F.count("*") / BLOCK).alias("salts")).withColumnRenamed("own", "cell"))  # a row for each pivot and length
    sides = -(-at.count() // (ASKERS * BLOCK)) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    members = at.toDF(*at.columns).select("id", "unit", F.col("own").alias("cell"), *carried).join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    members = members.select("id", "unit", "cell", "salt", *carried, every(F.lit(sides).cast("long")).alias("side"))
    askers = at.select("id", "unit", "own", *carried, F.explode(asked).alias("cell"), F.pmod(F.xxhash64("id", F.lit("side")), F.lit(sides).cast("long")).alias("side"))
    askers = askers.join(salts, "cell").select("id", "unit", "own", "cell", "side", *carried, every(F.col("salts")).alias("salt"))
    kind = rows.schema["id"].dataType.simpleString()
    by = ["cell", "salt", "side"]
    turns, pairs = max(1, -(-(askers.count() + members.count()) // SENT_AT_ONCE)), None
    for turn in range(turns):
        of = lambda df: df.where(F.pmod(F.xxhash64(*by), F.lit(turns)) == turn)  # noqa: E731, B023
        met = of(askers).groupBy(*by).cogroup(of(members).groupBy(*by)).applyInPandas(lambda a, b: _met(a, b, least, may), f"x {kind}, y {kind}, same boolean")
        found = written(met.where("not same or x < y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
        pairs = found if pairs is None else pairs.unionAll(found)
    if also is None:
        return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))
    further = known.drop("unit", "dim")
    a, b = further.alias("a"), further.alias("b")
    pairs = pairs.join(a, F.col("x") == F.col("a.id")).join(b, F.col("y") == F.col("b.id")).where(also("a", "b"))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))


def equal_vector(c: Column) -> Column:
    """A text that is equal for equal vectors."""
    return F.coalesce(F.concat_ws(",", F.transform(c, lambda x: x.cast("double").cast("string"))), F.lit("none"))
