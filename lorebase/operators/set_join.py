"""An exact Jaccard self-join of sets, by signatures that similar sets must share.

The elements of a set fall into ``k`` parts by hash, and those of a part into
four.  Two sets that reach the threshold differ in at most H elements.  A part
has six signatures, each of two of its quarters: a part without a difference
shares six, one with differences in one, two or three quarters shares three, one
or none.  So sets that differ in D elements share ``6k`` signatures less 3 for
each of the first k differences, 2 for each of the next k and 1 for each of those
after, and ``k = H // 3 + 1 + slack`` parts are enough; a signature covers three
times the elements that one of H + 1 parts has by half, so few sets meet by
chance.  k belongs to a level, a range of set sizes, and a set whose partner may be of
the next level takes part in both.  Each set leaves out its most frequent
signatures, as many as it can spare; how frequent they are says a bounded sample,
which decides how much meets, never what is found, for all sets use one order.
A set also has a sketch, of the parities of 64 * SKETCH groups of its elements:
sets that differ in D elements have sketches that differ in at most D bits, so
most pairs that meet by chance go before any set is moved.

Signatures are computed a set at a time, without a shuffle, and kept a row for
each set; what meets is found by equi-joins, of so many signatures at a time
that the disk they need is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import drop, dropped_after, written

#: Below this threshold sets may differ in so much that parts select too little.
LEAST_THRESHOLD = 0.65
#: Enough for sets of 2e9 elements.
MAX_LEVELS = 96
#: Longs of a sketch.
SKETCH = 4
#: Sets whose signatures one batch has.
FEW = 512
#: Homes of so many sets are compared in blocks, of about so many sets.
LARGE, BLOCK = 32, 1024
#: Sets whose signatures are counted to know the frequent ones, and how many of these are known.
SAMPLE, FREQUENT = 16_384, 1 << 17
#: Signatures, and pairs with their sets, that one shuffle moves, roughly.
KEYS_AT_ONCE, PAIRS_AT_ONCE = 20_000_000, 2_000_000

#: The pairs of quarters that make signatures.
_PAIRS = [(i, j) for i in range(4) for j in range(i)]


def levels(threshold: float) -> list[tuple[int, int, int, int]]:
    """(level, least size that takes part, size that no longer does, parts) of all levels, by size."""
    differ = lambda n: math.floor(n * (1 - threshold) / (1 + threshold) + 1e-9)
    growth, low, out = max(1.25, 1 / threshold + 1e-9), 1, []
    while len(out) < MAX_LEVELS:
        high = max(low + 1, math.ceil(low * growth))
        most = differ(2 * (high - 1))
        out.append((len(out), math.ceil(threshold * low - 1e-9), high, most // 3 + 1 + most // 24))
        low = high
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(threshold: float, frequent: np.ndarray | None = None, counts: np.ndarray | None = None):
    """Batches (id, n, hashes) to (id, n, guest, keys, s0, ...): a row for each set and level; guests are too small to be of the level but for their partners.

    frequent: sorted keys with their counts, of which each set leaves out what it can spare; without them all keys stay.
    """
    table = levels(threshold)
    least, high, parts = (np.array([t[i] for t in table]) for i in (1, 2, 3))
    low = np.concatenate([[0], high[:-1]])
    ratio = (1 - threshold) / (1 + threshold)
    names = ["id", "n", "guest", "keys", *(f"s{i}" for i in range(SKETCH))]

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, FEW) for i in range(0, whole.num_rows, FEW)):
                n = b.column(1).to_numpy()
                lists = b.column(2)
                hashes = lists.flatten().to_numpy().view(np.uint64)
                start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                of = np.repeat(np.arange(len(n)), np.diff(start))
                odd = np.bincount(of * (64 * SKETCH) + (_mixed(hashes + np.uint64(7)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=len(n) * 64 * SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8).reshape(len(n), -1), axis=1).view(np.int64)
                row, level = np.nonzero((n[:, None] >= least) & (n[:, None] < high))
                k = parts[level]
                cell = np.concatenate([[0], np.cumsum(4 * k)])
                size = start[row + 1] - start[row]
                at = np.repeat(np.arange(len(row)), size)
                h = hashes[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[row][at]]
                sums = np.zeros(cell[-1], np.uint64)
                mixed = _mixed(h)
                np.add.at(sums, cell[at] + (mixed % (4 * k[at]).astype(np.uint64)).astype(np.int64), _mixed(mixed + np.uint64(1)))
                quarters = sums.reshape(-1, 4)
                two = np.stack([quarters[:, i] + quarters[:, j] for i, j in _PAIRS], axis=1).ravel()
                first = np.concatenate([[0], np.cumsum(6 * k)])
                owner = np.repeat(np.arange(len(row)), 6 * k)
                slot = level[owner].astype(np.uint64) << np.uint64(40) | (np.arange(first[-1]) - first[owner]).astype(np.uint64)
                keys = _mixed(two ^ _mixed(slot + np.uint64(1))).view(np.int64)
                if frequent is not None:
                    partner = np.minimum(np.floor(n[row] / threshold + 1e-9), high[level] - 1)
                    most = np.floor((n[row] + partner) * ratio + 1e-9).astype(np.int64)
                    shared = 6 * k - 3 * np.minimum(most, k) - 2 * np.clip(most - k, 0, k) - np.clip(most - 2 * k, 0, k)
                    spare = np.maximum(shared - 1, 0)
                    often = np.zeros(len(keys), np.int64)
                    if len(frequent):
                        place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                        often = np.where(frequent[place] == keys, counts[place], 0)
                    keys = keys[np.lexsort((keys, -often, owner))]
                    stays = np.arange(len(keys)) - first[owner] >= spare[owner]
                    keys = keys[stays]
                    first = np.concatenate([[0], np.cumsum(np.bincount(owner[stays], minlength=len(row)))])
                columns = [b.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(n[row] < low[level]), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(sketch[row, i]) for i in range(SKETCH))], names=names)

    return run


def may_be_similar(a: str, b: str, ratio: float) -> Column:
    """Whether the sketches of two sets admit that they differ in at most ``ratio`` times the sum of their sizes."""
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return apart <= F.floor((F.col(f"{a}.n") + F.col(f"{b}.n")) * ratio + 1e-9)


def sketches_admit(threshold: float):
    """(one, p, other, q) to a boolean for each of the pairs of rows p of one and q of other: whether their sizes n and sketches admit the threshold."""
    ratio = (1 - threshold) / (1 + threshold)

    def may(one: pd.DataFrame, p: np.ndarray, other: pd.DataFrame, q: np.ndarray) -> np.ndarray:
        n, m = one["n"].to_numpy()[p], other["n"].to_numpy()[q]
        bits = lambda df, i, at: df[f"s{i}"].to_numpy().view(np.uint64)[at]
        apart = sum(np.bitwise_count(bits(one, i, p) ^ bits(other, i, q)).astype(np.int64) for i in range(SKETCH))
        return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (apart <= np.floor((n + m) * ratio + 1e-9))

    return may


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("n").cast("long").alias("n"), F.transform("items", lambda x: F.xxhash64(x)).alias("h"))


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, n long, guest boolean, keys array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH))


def sketches(rows: DataFrame) -> DataFrame:
    """id, s0, s1, ... of rows (id, items, n), n > 0."""
    def run(batches, one=_signatures(0.999)):
        for b in one(batches):
            yield b.filter(pc.invert(b.column(2)))  # each set is of one level that it is no guest of

    return _hashed(rows).mapInArrow(run, _schema(rows)).drop("n", "guest", "keys")


def signatures(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, n, guest, keys, s0, ...): the keys that sets of rows (id, items, n) have to meet by, a row for each set and level.

    items are distinct, n > 0 is their number; ids are unique.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"thresholds below {LEAST_THRESHOLD} need another join")
    hashed = _hashed(rows)
    some = hashed.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(max(1, rows.count() // SAMPLE))) == 0)
    seen = some.mapInArrow(_signatures(threshold), _schema(rows)).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    seen = seen.orderBy(F.desc("c"), "key").limit(FREQUENT).toPandas().sort_values("key")
    return written(hashed.mapInArrow(_signatures(threshold, seen["key"].to_numpy(np.int64), seen["c"].to_numpy(np.int64)), _schema(rows)))


def may_meet(a: str, b: str, threshold: float) -> Column:
    """Whether two rows of ``signatures`` with one key may be similar; guests of a level meet in their own."""
    reach = F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n") - 1e-9
    return ~(F.col(f"{a}.guest") & F.col(f"{b}.guest")) & reach & may_be_similar(a, b, (1 - threshold) / (1 + threshold))


def _in_turns(keys: DataFrame, meet) -> DataFrame:
    """The distinct pairs that ``meet(only)`` gives for each share of the keys; only(rows) has a row for each key of the share."""
    n = keys.agg(F.sum(F.size("keys"))).first()[0] or 0
    turns, out = max(1, -(-n // KEYS_AT_ONCE)), None
    for turn in range(turns):
        only = lambda rows: rows.withColumn("key", F.explode(F.filter("keys", lambda k: F.pmod(k, F.lit(turns)) == turn))).drop("keys")  # noqa: E731, B023
        found = written(meet(only).distinct())
        out = found if out is None else out.unionAll(found)
    return out if turns == 1 else written(out.distinct())


def met(some: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, each once: sets of ``some`` and of ``others``, both rows of ``signatures``, that may be similar."""

    def meet(only):
        a, b = only(some).alias("a"), only(others).alias("b")
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & may_meet("a", "b", threshold))
        return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))

    return _in_turns(others, meet)


def met_within(keys: DataFrame, threshold: float, apart: Column | None = None) -> DataFrame:
    """(a, b), a < b, each once: sets of rows of ``signatures`` that may be similar; apart: a condition on rows ``a`` and ``b`` besides."""

    def meet(only):
        a, b = only(keys).alias("a"), only(keys).alias("b")
        also = may_meet("a", "b", threshold) if apart is None else apart & may_meet("a", "b", threshold)
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & also)
        return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))

    return _in_turns(keys, meet)


def first_met(keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, each once: each set with the least of all that have a key of its, where they may be similar."""
    columns = [c for c in keys.columns if c != "keys"]

    def meet(only):
        rows = only(keys)
        before = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = rows.select(F.struct(*columns).alias("b"), F.first(F.struct(*columns)).over(before).alias("a"))
        return both.where((F.col("a.id") < F.col("b.id")) & may_meet("a", "b", threshold)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))

    return _in_turns(keys, meet)


def by_shares(pairs: DataFrame, rows: DataFrame, use) -> DataFrame:
    """use(pairs, rows with the ids of a) of shares of the pairs (a, b), written one after the other, so that each moves a bounded number of rows."""
    turns, out = max(1, -(-pairs.count() // PAIRS_AT_ONCE)), None
    for turn in range(turns):
        of = lambda df, c: df if turns == 1 else df.where(F.pmod(F.xxhash64(c, F.lit("turn")), F.lit(turns)) == turn)  # noqa: E731, B023
        found = written(use(of(pairs, "a"), of(rows, "id")))
        out = found if out is None else out.unionAll(found)
    return out


def shared(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, both, _na, _nb) of the pairs that reach the threshold: what they share, and their sizes; with mark in rows, also _ma and _mb."""
    more = [c for c in ("n", "mark") if c in rows.columns]
    side = lambda c, some: some.select(F.col("id").alias(c), F.col("items").alias(f"_{c}"), *(F.col(x).alias(f"_{x[0]}{c}") for x in more))

    def use(pairs, left):
        both = pairs.join(side("a", left), "a").join(side("b", rows), "b").withColumn("both", F.size(F.array_intersect("_a", "_b")))
        both = both.where(F.col("both") >= threshold * (F.col("_na") + F.col("_nb") - F.col("both")) - 1e-6)
        return both.select("a", "b", "both", *(f"_{x[0]}{c}" for x in more for c in "ab"))

    return by_shares(pairs, rows, use)


def _group_pairs(threshold: float):
    """One group (id, items, mark, block, low, high) to (a, b, both, _na, _nb, _ma, _mb): its pairs a < b that reach the threshold, within a block or between two."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows["items"].map(len).to_numpy()
        codes, _ = pd.factorize(np.concatenate(rows["items"].to_numpy()))
        has = np.zeros((len(rows), codes.max() + 1), np.float32)
        has[np.repeat(np.arange(len(rows)), counts), codes] = 1
        one = rows["low"].iloc[0] == rows["high"].iloc[0]
        left = np.arange(len(rows)) if one else np.nonzero((rows["block"] == rows["low"]).to_numpy())[0]
        right = left if one else np.nonzero((rows["block"] == rows["high"]).to_numpy())[0]
        both = has[left] @ has[right].T  # whole numbers below 2^24
        i, j = np.nonzero(both >= threshold * (counts[left][:, None] + counts[right][None, :] - both) - 1e-6)
        if one:
            i, j = i[i < j], j[i < j]
        shared, i, j = both[i, j].astype(np.int32), left[i], right[j]
        ids, marks = rows["id"].to_numpy(), rows["mark"].to_numpy()
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "both": shared, "_na": counts[i], "_nb": counts[j], "_ma": marks[i], "_mb": marks[j]})

    return run


def similar_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, both): all pairs a < b of rows (id, items, n) whose sets reach the Jaccard threshold, and what they share.

    With a further column mark in rows, a long, also the sizes _na, _nb and marks
    _ma, _mb of both.  Near copies share nearly all signatures, so they would
    meet many times.  Each set's home is the least similar set among those that
    are first with a signature of its.  Sets of one large home are compared with
    each other in blocks, each pair once; all others meet by their signatures.
    """
    names = ["a", "b", "both"] + (["_na", "_nb", "_ma", "_mb"] if "mark" in rows.columns else [])
    whole = rows if "mark" in rows.columns else rows.withColumn("mark", F.lit(1).cast("long"))
    with dropped_after(rows.sparkSession) as kept:
        keys = signatures(rows, threshold)
        home = written(shared(first_met(keys, threshold), rows, threshold).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("home")))
        hubs = home.select(F.col("home").alias("id")).distinct().join(home, "id", "left_anti")
        home = home.unionByName(hubs.select("id", F.col("id").alias("home")))
        large = home.groupBy("home").agg(F.count("*").alias("c")).where(F.col("c") >= LARGE)
        home = written(home.join(large, "home").select("id", "home", F.ceil(F.col("c") / BLOCK).alias("blocks")))
        at = whole.select("id", "items", "mark").join(home, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        at = at.select("id", "items", "mark", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        kind = rows.schema["id"].dataType.simpleString()
        inside = at.groupBy("home", "low", "high").applyInPandas(_group_pairs(threshold), f"a {kind}, b {kind}, both int, _na int, _nb int, _ma long, _mb long")
        kept.append(written(inside.select(names)))
        unmarked, keys = keys, written(keys.join(home.select("id", "home"), "id", "left"))
        drop(rows.sparkSession, unmarked)
        apart = F.col("a.home").isNull() | F.col("b.home").isNull() | (F.col("a.home") != F.col("b.home"))
        kept.append(written(shared(met_within(keys, threshold, apart), whole if "mark" in rows.columns else rows, threshold).select(names)))
    return kept[0].unionByName(kept[1])
