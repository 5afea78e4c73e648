"""Connected components by contraction.

In each round every node points at the least key among itself and its
neighbours, and every edge moves to what its ends point at; edges inside one
node vanish.  Keys must be hashes, so that the order is random and a constant
share of the nodes goes per round, for paths as for stars.  The pointers of
all rounds composed give each node's root.

All steps are equi-joins and minima with map-side combination over written
tables; a node with very many neighbours is a skewed join key with plain
exchanges on both sides, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b)."""
    both = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("near")))
    live = scratch.save(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    pointers: list[DataFrame] = []
    while live.limit(1).count():
        if len(pointers) == max_rounds:
            raise RuntimeError("components did not settle")
        at = scratch.save(both(live).groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("root")))
        pointers.append(at)
        ends = lambda c: at.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved = live.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root")
        following = scratch.save(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        scratch.drop(live)
        live = following
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pointers[-1]
    for earlier in reversed(pointers[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = earlier.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
