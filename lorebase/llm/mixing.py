"""Mixing sources to target weights with a low-discrepancy schedule.

The words of each source, its documents in a shuffled order, form a line; the
line is cut into blocks of equal length.  The golden-ratio sequence
``frac(slot * phi)`` is mapped through the cumulative targets, which names the
source of every slot; a slot's rank among its source's slots is the block that
it takes, round after round.  So any stretch of the schedule has the sources
near their shares, and a source's total is its target.

Every join is an equi-join (slots meet sources on a cell of the unit
interval, documents meet slots on source and block), so nothing is broadcast
on trust, and ranks and running sums are built in two levels -- inside
(source, bucket) and over the bucket sums -- so that a source with a third of
all rows is never sorted in one task.

Null text has size 0; null source is a source of its own, last in order.
Repeated rows (same doc_id) are told apart by their place on the line, and
equal ones are interchangeable.  A table without words gives taken 0 and an
empty schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Words in a block.
BLOCK = 512
#: Cells of the unit interval, for the equi-join of slots with sources.
CELLS = 4096
#: Slots that are ranked together.
RUN = 4096
#: The fractional part of the golden ratio.
PHI = 0.6180339887498949
#: A source is gone through at most so many times.
MAX_ROUNDS = 3


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target from rows (source, size).

    Weights 1, 2, 3, 1, ... go by code point order of the source, null last.
    The targets share the sum of all sizes by weight; none is above
    MAX_ROUNDS times its source's size.  With r = bound / weight ascending,
    the bounded sources are a prefix of that order, so two running sums give
    the level that re-sharing ends at.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = by.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("bound", MAX_ROUNDS * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    w = w.withColumns(
        {
            "left": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # the level if the sources from this one on are open; of those that hold, the first is the highest
    w = w.withColumn("level", F.col("left") / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))
    w = w.withColumn("level", F.max(fits).over(all_rows))
    target = F.least(F.col("bound"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def shuffled_line(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, text_hash, at: where each document starts on its source's line."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("off", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return out.select("doc_id", "source", "size", "text_hash", (F.col("base") + F.col("off")).alias("at"))


def schedule(targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """slot, source, rank, round, block, words: what each slot of the mix takes.

    total: the sum of all sizes.  Slots whose source has already had its
    target are left out; what a source still lacks at the end follows as
    further slots, one of each source in turn.
    """
    spark = targets.sparkSession
    n = -(-total // block)
    line = targets.where("target > 0 and source_size > 0").withColumn("need", F.round("target").cast("long"))
    rounds, blocks = F.floor(F.col("need") / F.col("source_size")), F.ceil(F.col("source_size") / block)
    line = line.withColumn("slots", rounds * blocks + F.ceil((F.col("need") % F.col("source_size")) / block))
    cum = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    share = F.sum("target").over(Window.partitionBy())
    line = line.withColumn("hi", F.sum("target").over(cum) / share).withColumn("lo", F.coalesce(F.lag("hi").over(cum), F.lit(0.0)))
    line = line.withColumn("number", F.row_number().over(cum) - 1).withColumn("sources", F.count("*").over(Window.partitionBy()))
    cells = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least(F.col("hi"), F.lit(0.9999999999)) * CELLS))))
    u = F.col("slot") * F.lit(PHI)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("u", u - F.floor(u))
    hit = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells.select("cell", "source", "lo", "hi"), "cell")
    hit = hit.where("u >= lo and u < hi").select("slot", "source", F.floor(F.col("slot") / RUN).alias("run"))
    per_run = hit.groupBy("source", "run").agg(F.count("*").alias("n"))
    over = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = per_run.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "run").orderBy("slot")
    ranked = hit.withColumn("k", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    ranked = ranked.select("slot", "source", (F.col("base") + F.col("k")).alias("rank"))
    had = ranked.groupBy("source").agg(F.count("*").alias("had")).withColumnRenamed("source", "s")
    rest = line.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0)))
    rest = rest.where("had < slots").withColumn("rank", F.explode(F.sequence("had", F.col("slots") - 1)))
    rest = rest.select((F.lit(n) + F.col("rank") * F.col("sources") + F.col("number")).alias("slot"), "source", "rank")
    every = ranked.unionByName(rest)
    info = line.select(F.col("source").alias("s"), "source_size", "need", "slots")
    every = every.join(info, F.col("source").eqNullSafe(F.col("s"))).where("rank < slots")
    blocks = F.ceil(F.col("source_size") / block)
    every = every.withColumn("round", F.floor(F.col("rank") / blocks)).withColumn("block", F.col("rank") % blocks)
    at = F.col("block") * block
    left = F.col("need") - F.col("round") * F.col("source_size") - at
    words = F.least(F.lit(block), F.col("source_size") - at, left).cast("long")
    return every.withColumn("words", words).where("words > 0 and round < " + str(MAX_ROUNDS)).select("slot", "source", "rank", "round", "block", "words")


def spans(line: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, round, doc_id, source, text_hash, at, size, first, n: the stretch of words that a slot takes of a document."""
    pieces = line.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    s = slots.select("slot", F.col("source").alias("s"), F.col("block").alias("b"), "round", "words")
    both = pieces.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("words"))
    both = both.withColumn("first", lo - F.col("at")).withColumn("n", hi - lo)
    return both.where("n > 0").select("slot", "round", "doc_id", "source", "text_hash", "at", "size", "first", "n")


def mix(docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(line, targets, slots, spans) of the mix of ``docs`` (doc_id, text, source)."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size"))
    targets = source_targets(sizes)
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    line = shuffled_line(docs, seed)
    slots = schedule(targets, int(total), block)
    return line, targets, slots, spans(line, slots, block)


def mix_report(docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    line, targets, _, taken = mix(docs, block, seed)
    got = taken.groupBy("source", "at", "size").agg(F.sum("n").alias("taken"))
    got = got.select(F.col("source").alias("s"), F.col("at").alias("a"), F.col("size").alias("z"), "taken")
    # on a line, only documents of size 0 share their start with another one
    rows = line.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") == F.col("z")), "left").drop("s")
    t = targets.withColumnRenamed("source", "s")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The mix as documents: a row of ``docs`` for each round in which the mix takes of it.

    The blocks of a round follow each other, so only the last document of a
    source's last round is cut; its text is then the words taken, joined by
    spaces.
    """
    _, _, _, taken = mix(docs, block, seed)
    took = taken.groupBy("doc_id", "source", "text_hash", "at", "size", "round").agg(F.sum("n").alias("n"))
    took = took.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), F.col("size").alias("_size"), F.col("n").alias("_taken"))
    every = docs.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "source", "_hash"])
    rows = every.join(took, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("_hash").eqNullSafe(F.col("_h")))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_taken") < F.col("_size"), words).otherwise(F.col("text")))
    return rows.select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight,
        {MAX_ROUNDS} * source_size::DOUBLE AS bound FROM g),
v AS (SELECT a.source, a.bound / a.weight AS r,
        ((SELECT sum(source_size)::DOUBLE FROM w) - coalesce((SELECT sum(bound) FROM w b WHERE b.bound / b.weight < a.bound / a.weight), 0))
        / (SELECT sum(weight) FROM w b WHERE b.bound / b.weight >= a.bound / a.weight) AS level FROM w a),
t AS (SELECT source, source_size, least(bound, (SELECT max(level) FROM v WHERE level <= r) * weight) AS target FROM w),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM d)
SELECT doc_id, size, source_size, target, ({" + ".join(f"greatest(0, least(start_at + size, round(target)::BIGINT - {k} * source_size) - start_at)" for k in range(MAX_ROUNDS))})::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
