"""N-gram Jaccard join by a token-group matrix.

A document is the set of its word shingles' hashes; equal sets are one class.

* Parts: the hash range is cut into ``k`` parts, and a set's tokens in one part
  are a token of the matrix.  Two sets that reach the threshold differ in at
  most ``H`` tokens, so of ``k = H + 1 + slack`` parts at least ``1 + slack``
  are equal.  H and k belong to a level, a range of set sizes; a set whose
  partner may be of the next level takes part in both.  Empty parts are left
  out, but by sets with more than ``slack`` of them: two such sets have them in
  common, any other pair has an equal part that is not empty.
* Common parts: a pair shares at least one part more than either set can spare
  (by its own size, its partner can only differ in so many).  So each set
  leaves out as many of its parts as it can spare, the most frequent first, in
  one order for all: the rarest common part stays on both sides.  A passage that
  very many documents share brings only those together that consist of little
  else.
* Groups: classes with one least token are one group, so two classes are in one
  group as often as they are similar.  Members are compared exactly in blocks;
  what that connects are the groups of the matrix.
* Matrix: (part, group).  A part held by one group alone is settled.
* Bound: in parts that several groups hold, each group is stored as the union
  of its members that hold the part: the greatest number of tokens in each of
  256 hash ranges.  The smaller ones of a class's numbers and the union's,
  summed, bound the intersection with every member from above.
* Open: only groups that can reach the threshold are opened, and members are
  bounded in the same way one by one.  First only the best pair of each two
  groups is compared exactly, in rounds: copies then need a comparison for each
  merge, not one per pair.  Pairs of groups that stay apart are compared pair
  by pair, as far as the bound admits them.

Every pair of classes in different groups that shares a part is bounded or
compared, so no link is lost.  Parts that many classes hold are cut into blocks
of BLOCK members by BLOCK askers, the members of the largest group never ask,
and pairs are only emitted where the bound admits them.

Null or blank text: empty set, linked with nothing.  Rows with the same set
are linked; ties and repeated rows need no rule.  A null doc_id takes part
like any other but is no component_id unless all of its component are null.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_texts, mix64, slices
from .components import components

SHINGLE, THRESHOLD = 4, Fraction(85, 100)
#: Members of a group that one task holds.
BLOCK = 256
#: Rounds that compare the best pair of two groups before all pairs are; they save comparisons and lose none.
MERGES = 6
#: Parts of at most so many classes are compared many at a time.
SMALL = 24
#: Set keys that a task remembers, to give each set's parts once.
SEEN = 500_000
#: The rows of a component's hot key are spread over so many.
SALTS = 16


#: op6 in SQL: all pairs that share a shingle, and their components.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id
"""


class _Codes(dict):
    def __missing__(self, w: bytes) -> int:
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


def token_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; A-Z lower-cased, fewer words are one shingle."""
    codes = _Codes()
    words = [t.lower().split() for t in texts]  # of bytes: only A-Z, and just the ASCII white space
    flat = np.fromiter((codes[w] for ws in words for w in ws), dtype=np.uint64)
    h = np.zeros(len(flat), dtype=np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for k in range(shingle):
        h[: len(flat) - k] = (h[: len(flat) - k] ^ flat[k:]) * step
        h ^= h >> np.uint64(32)
    h = mix64(h)
    out, a = [], 0
    for ws in words:
        n = len(ws)
        if n >= shingle:
            out.append(np.unique(h[a : a + n - shingle + 1]))
        elif n:
            v = np.array([n], dtype=np.uint64)
            for x in flat[a : a + n]:
                v = mix64((v ^ x) * step)
            out.append(v)
        else:
            out.append(np.empty(0, dtype=np.uint64))
        a += n
    return out


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a token set."""
    total = mix64(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total], dtype=np.uint64))[0])


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def sketch(tokens: np.ndarray) -> bytes | None:
    """How many tokens lie in each 256th of the hash range; None where a byte cannot hold it."""
    n = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 255 else None


class Levels:
    """Ranges of set sizes, and into how many parts each one's sets are cut."""

    def __init__(self, threshold: Fraction):
        num, den = threshold.numerator, threshold.denominator
        self.threshold, self.lows, self.parts, self.slack = threshold, [1], [], []
        growth = max(Fraction(3, 2), 1 / threshold)
        while self.lows[-1] < 1 << 40:
            low = self.lows[-1]
            self.lows.append(max(low + 1, math.ceil(low * growth)))
            differ = 2 * (self.lows[-1] - 1) * (den - num) // (den + num)
            empty = math.exp(-num * low / den / (1.1 * differ)) if differ else 0
            slack = 2 + math.ceil(1.5 * differ * empty)
            self.slack.append(slack)
            self.parts.append(differ + 1 + slack if differ else 0)  # no difference: equal sets only, one class
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cut(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of level i begin in the hash range, but the first, and a hash of each part's place."""
        if i not in self._known:
            k = np.uint64(self.parts[i])
            at = np.arange(self.parts[i], dtype=np.uint64)
            self._known[i] = at[1:] * (np.uint64(2**64 - 1) // k), mix64(at + np.uint64((i << 40) + 1))
        return self._known[i]

    def spare(self, i: int, n: int) -> int:
        """How many more parts than one a set of n tokens has in common with any partner at level i, if it has no empty ones."""
        num, den = self.threshold.numerator, self.threshold.denominator
        partner = min(n * den // num, self.lows[i + 1] - 1)
        return self.parts[i] - 1 - (n + partner) * (den - num) // (den + num)

    def of(self, n: int) -> list[int]:
        """The levels at which a set of n tokens takes part."""
        i = int(np.searchsorted(self.lows, n, side="right")) - 1
        both = n * self.threshold.denominator >= self.threshold.numerator * self.lows[i + 1]
        return [x for x in ((i, i + 1) if both else (i,)) if self.parts[x]]


def part_keys(tokens: np.ndarray, levels: Levels) -> list[tuple[np.ndarray, int]]:
    """For each of the set's levels: a 64-bit hash of the tokens in each part, and how many of them it can spare."""
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens, out=sums[1:])
    out = []
    for i in levels.of(len(tokens)):
        edges, place = levels.cut(i)
        at = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
        count = np.diff(at)
        total = sums[at]
        content = total[1:] - total[:-1] + count.astype(np.uint64)
        empty = len(count) - int(np.count_nonzero(count))
        spare = 0
        if empty <= levels.slack[i]:
            spare = levels.spare(i, len(tokens)) - empty
            held = count > 0
            content, place = content[held], place[held]
        out.append((mix64(content * np.uint64(0x9E3779B97F4A7C15) ^ place), spare))
    return out


def classes(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n, key, least, sketch, parts, spare, second of every row: its set's size, hash, least token, sketch and parts.

    spare: how many parts of each level the set can leave out; second: where
    those of the second level begin.  Parts are null where the task has
    already given those of the same set.
    """

    def run(batches):
        levels, seen = Levels(threshold), set()
        for b in slices(batches, "text"):
            sets = token_sets(byte_texts(b.column(2)), shingle)
            keys = [set_key(s) for s in sets]
            parts, spare, second = [], [], []
            for s, key in zip(sets, keys):
                if not len(s) or key in seen:
                    parts.append(None)
                    spare.append(None)
                    second.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                own = part_keys(s, levels)
                parts.append(np.concatenate([x for x, _ in own]).view(np.int64) if own else np.empty(0, dtype=np.int64))
                spare.append([x for _, x in own])
                second.append(len(own[0][0]) if own else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], type=pa.int64()), _signed(keys), _signed([s[0] if len(s) else 0 for s in sets]), pa.array([sketch(s) for s in sets], type=pa.binary()),
                 pa.array(parts, type=pa.list_(pa.int64())), pa.array(spare, type=pa.list_(pa.int32())), pa.array(second, type=pa.int32())],
                names=["doc_id", "text_hash", "n", "key", "least", "sketch", "parts", "spare", "second"],
            )

    schema = "doc_id long, text_hash long, n long, key long, least long, sketch binary, parts array<long>, spare array<int>, second int"
    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_hash", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """key, tokens of every row."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = token_sets(byte_texts(b.column(0)), shingle)
            yield pa.RecordBatch.from_arrays([_signed([set_key(s) for s in sets]), pa.array([s.view(np.int64) for s in sets], type=pa.list_(pa.int64()))], names=["key", "tokens"])

    return docs.select("text").mapInArrow(run, "key long, tokens array<long>")


def runs_of(batches, columns: list[str]):
    """The rows of each run of equal values in ``columns``, as one table; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        values = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)))
        a = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[a]:
                if last is not None and values[a] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                last = values[a]
                held.append(b.slice(a, i - a))
                a = i
    if held:
        yield last, pa.Table.from_batches(held)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(tokens: list[np.ndarray], i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of ``others`` reach the threshold with ``i``."""
    own = tokens[i]
    sizes = np.array([len(tokens[j]) for j in others])
    near = np.minimum(sizes, len(own)) * den >= num * np.maximum(sizes, len(own))
    others, sizes = others[near], sizes[near]
    if not len(others):
        return others
    flat = np.concatenate([tokens[j] for j in others])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return others[den * both >= num * (len(own) + sizes - both)]


def connect(tokens: list[np.ndarray], forest: Forest, i: int, others: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Join ``i`` with those of ``others`` that it links to, comparing only where that can connect."""
    edges = []
    roots = np.array([forest.root(j) for j in others])
    apart = roots != forest.root(i)
    others, roots = others[apart], roots[apart]
    while len(others):  # one of each component first: copies then need no more
        _, first = np.unique(roots, return_index=True)
        hits = linked(tokens, i, others[first], num, den)
        for j in hits:
            if forest.join(i, int(j)):
                edges.append((i, int(j)))
        rest = np.ones(len(others), dtype=bool)
        rest[first] = False
        others = others[rest]
        roots = np.array([forest.root(j) for j in others], dtype=np.int64)
        apart = roots != forest.root(i)
        others, roots = others[apart], roots[apart]
        if len(others) and len(first) < 8:  # few components: the rest at once
            for j in linked(tokens, i, others, num, den):
                if forest.join(i, int(j)):
                    edges.append((i, int(j)))
            break
    return edges


def _lists(column) -> list[np.ndarray]:
    """Token lists, sorted as unsigned numbers."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def group_edges(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): a spanning forest of the links in each block of rows (g, block, key, tokens)."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        for _, t in runs_of(batches, ["g", "block"]):
            keys, tokens = t.column("key").to_numpy(), _lists(t.column("tokens"))
            forest, edges = Forest(len(keys)), []
            for i in range(1, len(keys)):
                edges += connect(tokens, forest, i, np.arange(i), num, den)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], names=["a", "b"])

    parts = rows.select("g", "block", "key", "tokens").repartition("g", "block").sortWithinPartitions("g", "block", "key")
    return parts.mapInArrow(run, "a long, b long").where("a <> b")


class Sketches:
    """The sketches of a block's rows, and the bound that they give."""

    def __init__(self, table: pa.Table, threshold: Fraction):
        raw = table.column("sketch").to_pylist()
        self.n = table.column("n").to_numpy()
        self.free = np.array([x is None for x in raw], dtype=bool)
        self.m = np.frombuffer(b"".join(x or bytes(256) for x in raw), dtype=np.uint8).reshape(-1, 256)
        self.num, self.den = threshold.numerator, threshold.denominator

    def most(self, i: int, others: np.ndarray) -> np.ndarray:
        """The bound on the tokens that row i shares with each of ``others``."""
        most = np.minimum(self.m[others], self.m[i]).sum(axis=1, dtype=np.int64)
        return np.where(self.free[others] | self.free[i], np.minimum(self.n[others], self.n[i]), most)

    def admits(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` may reach the threshold with row i."""
        return others[(self.den + self.num) * self.most(i, others) >= self.num * (self.n[others] + self.n[i])]

    def opens(self, i: int, union: np.ndarray, lo: np.ndarray, hi: np.ndarray, free: np.ndarray) -> np.ndarray:
        """For groups of these unions and sizes, whether row i may reach the threshold with a member."""
        n = self.n[i]
        most = np.minimum(union, self.m[i]).sum(axis=1, dtype=np.int64)
        near = (n * self.den >= self.num * lo) & (hi * self.den >= self.num * n)
        return near & (free | self.free[i] | (self.den * most >= self.num * np.maximum(n, lo)))


def within_reach(rows: DataFrame, threshold: Fraction) -> DataFrame:
    """g, key of the rows (g, block, key, n, sketch) whose sketch admits a link with another row of the block."""

    def run(batches):
        for (g, _), t in runs_of(batches, ["g", "block"]):
            key, s = t.column("key").to_numpy(), Sketches(t, threshold)
            good = np.zeros(len(key), dtype=bool)
            for i in range(1, len(key)):
                if len(ok := s.admits(i, np.arange(i))):
                    good[ok] = good[i] = True
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(good.sum()), g, dtype=np.int64)), pa.array(key[good])], names=["g", "key"])

    parts = rows.select("g", "block", "key", "n", "sketch").repartition("g", "block").sortWithinPartitions("g", "block")
    return parts.mapInArrow(run, "g long, key long").distinct()


def whole_runs(batches, columns: list[str]):
    """Tables of whole runs of equal values in ``columns``, and where each run begins."""
    held: list[pa.RecordBatch] = []
    for b in (b for b in batches if b.num_rows):
        v = [b.column(b.schema.get_field_index(c)).to_numpy() for c in columns]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in v])) + 1
        if held:
            last = held[-1]
            if any(last.column(last.schema.get_field_index(c))[last.num_rows - 1].as_py() != x[0] for c, x in zip(columns, v)):
                yield _with_runs(held, columns)
                held = []
        if not len(new):
            held.append(b)
            continue
        yield _with_runs([*held, b.slice(0, int(new[-1]))], columns)
        held = [b.slice(int(new[-1]))]
    if held:
        yield _with_runs(held, columns)


def _with_runs(held: list[pa.RecordBatch], columns: list[str]):
    t = pa.Table.from_batches(held)
    v = [t.column(c).to_numpy() for c in columns]
    return t, np.r_[0, np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in v])) + 1]


def open_groups(rows: DataFrame, threshold: Fraction, best: bool) -> DataFrame:
    """part, one, two, share, a, b: pairs of classes of the groups one and two that the bounds admit, in each block of rows (part, block, key, label, n, sketch, asks).

    asks is 0 for classes that are asked, 2 for those that ask, 1 for both.
    With ``best``, only the pair of each two groups with the greatest bound on
    its share of common tokens.
    """

    def few(s: Sketches, label, begin, size):
        """Admitted pairs of rows in runs of few rows, all at once."""
        at, many = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
        row = at + np.repeat(begin, size)
        later = many - 1 - at
        i = np.repeat(row, later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        ok = (label[i] != label[j]) & (np.minimum(s.n[i], s.n[j]) * s.den >= s.num * np.maximum(s.n[i], s.n[j]))
        i, j = i[ok], j[ok]
        most = np.concatenate([np.empty(0, np.int64), *(np.minimum(s.m[i[a : a + 8192]], s.m[j[a : a + 8192]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), 8192))])
        most = np.where(s.free[i] | s.free[j], np.minimum(s.n[i], s.n[j]), most)
        ok = (s.den + s.num) * most >= s.num * (s.n[i] + s.n[j])
        return i[ok], j[ok], most[ok] / (s.n[i[ok]] + s.n[j[ok]])

    def many(s: Sketches, label, asks, rows):
        """Admitted pairs of an asker and a member of a group that can reach the threshold, in one run."""
        member = rows[asks[rows] < 2]
        member = member[np.argsort(label[member], kind="stable")]
        if not len(member):
            return
        first = np.flatnonzero(np.r_[True, label[member[1:]] != label[member[:-1]]])
        size = np.diff(np.r_[first, len(member)])
        of, union = label[member[first]], np.maximum.reduceat(s.m[member], first, axis=0)
        lo, hi, free = np.minimum.reduceat(s.n[member], first), np.maximum.reduceat(s.n[member], first), np.logical_or.reduceat(s.free[member], first)
        for i in rows[asks[rows] > 0]:
            opened = s.opens(i, union, lo, hi, free) & (of != label[i])
            if opened.any():
                near = s.admits(i, member[np.repeat(opened, size)])
                yield np.full(len(near), i), near, s.most(i, near) / (s.n[near] + s.n[i])

    def run(batches):
        seen: set = set()
        for t, begin in whole_runs(batches, ["part", "block"]):
            part, key, label, asks = (t.column(c).to_numpy() for c in ("part", "key", "label", "asks"))
            s = Sketches(t, threshold)
            size = np.diff(np.r_[begin, len(key)])
            small = (size <= SMALL) & (asks[begin] < 2)
            found = [few(s, label, begin[small], size[small])]
            for x, n in zip(begin[~small], size[~small]):
                found += many(s, label, asks, np.arange(x, x + n))
            i, j, share = (np.concatenate(c) for c in zip(*found))
            if not len(i):
                continue
            a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
            one, two = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            if best:
                order = np.lexsort([b, a, -share, two, one, part[i]])
                p, x, y = part[i][order], one[order], two[order]
                keep = order[np.r_[True, (p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]]
            else:
                keep = []
                for k, pair in enumerate(zip(a.tolist(), b.tolist())):
                    if pair not in seen:
                        keep.append(k)
                        if len(seen) < SEEN:
                            seen.add(pair)
                keep = np.array(keep, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (part[i], one, two, share, a, b)], names=["part", "one", "two", "share", "a", "b"])

    cols = ["part", "block", "key", "label", "n", "sketch", "asks"]
    return rows.select(*cols).repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(run, "part long, one long, two long, share double, a long, b long")


def _grid(rows: DataFrame, block: int) -> DataFrame:
    """The rows (part, key, label, largest, ...) by block, with asks as in ``open_groups``; parts of many rows as each block of members with each block of askers."""
    ask = F.col("label") != F.col("largest")
    small = rows.where(f"many <= {block}").withColumn("block", F.lit(0).cast("long")).withColumn("asks", F.when(ask, 1).otherwise(0))
    large = rows.where(f"many > {block}")
    cut = lambda n: F.pmod(F.xxhash64("key"), F.ceil(F.col(n) / block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block) - 1))
    members = large.withColumn("m", cut("many")).withColumn("q", every("askers")).withColumn("asks", F.lit(0))
    askers = large.where(ask).withColumn("q", cut("askers")).withColumn("m", every("many")).withColumn("asks", F.lit(2))
    large = members.unionByName(askers).withColumn("block", F.col("m") * (1 << 32) + F.col("q"))
    return small.unionByName(large.select(small.columns))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, component, text_hash of every row of ``docs`` (doc_id, text).

    component is a hash that names the component whatever doc_ids repeat or are null; text_hash is xxhash64 of the text.
    """
    s = Scratch(docs.sparkSession)
    num, den = threshold.numerator, threshold.denominator
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    rows = s.save(classes(docs, shingle, threshold))
    held = rows.where("parts is not null").select(F.posexplode("parts").alias("pos", "part"), "key", "spare", "second")
    level = F.when(F.col("pos") < F.col("second"), 0).otherwise(1)
    held = held.select("part", "key", level.alias("level"), F.get("spare", level).alias("spare"))
    # parts of two classes or more: the least and the greatest key differ
    shared = held.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("part", "c")
    met = held.join(s.save(shared), "part").distinct()
    common = Window.partitionBy("key", "level").orderBy(F.desc("c"), "part")
    met = s.save(met.withColumn("r", F.row_number().over(common)).where("r > spare").select("part", "key"))
    home = rows.select("key", "n", F.col("least").alias("g"), "sketch", "doc_id").join(met.select("key").distinct(), "key", "left_semi")
    home = s.save(home.groupBy("key").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")))

    def sets_of(live: DataFrame) -> DataFrame:
        """key, tokens of the classes in ``live``, from the rows that have the least doc_id of one."""
        wanted = s.save(home.join(live.select("key").distinct(), "key", "left_semi").select("key", "doc_id"))
        text = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        # a class whose rows all have a null doc_id: no id finds them, their key does
        text = text.unionByName(docs.where("doc_id is null"))
        return s.save(full_sets(text, shingle).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold."""
        sets = sets_of(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))))
        side = lambda c: sets.select(F.col("key").alias(c), F.col("tokens").alias(f"{c}_tokens"))
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        exact = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("a_tokens") + F.size("b_tokens")).alias("n"))
        return exact.where(F.col("both") * (den + num) >= F.col("n") * num).select("a", "b")

    def labels(now: DataFrame) -> DataFrame:
        return home.select("key").join(now.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("label"))

    def unsettled(matrix: DataFrame, now: DataFrame) -> DataFrame:
        """part, key, label of the parts that several groups hold."""
        matrix = s.save(matrix.select("part", "key").join(labels(now), "key"))
        several = matrix.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("part")
        return s.save(matrix.join(several, "part", "left_semi"))

    # groups: classes with the same least token
    size = home.groupBy("g").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).where("size > 1")
    blocks = F.ceil(F.col("size") / block)
    members = home.join(size, "g").withColumn("block", F.when(F.col("size") > block, F.pmod(F.xxhash64("key"), blocks)).otherwise(F.lit(0).cast("long")))
    # every block of a large group has the group's pivot
    pivots = members.where(f"size > {block} and key = pivot").withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).where("block <> own").drop("own")
    members = s.save(members.unionByName(pivots).select("g", "block", "key", "n", "sketch"))
    live = s.save(within_reach(members, threshold))
    near = members.select("g", "block", "key").join(live, ["g", "key"], "left_semi").join(sets_of(live), "key")
    found = s.save(group_edges(near, threshold))
    now = s.save(components(found, s))
    matrix = unsettled(met, now)

    def opened(matrix: DataFrame, best: bool) -> DataFrame:
        """The pairs that the bounds admit in the matrix (part, key, label)."""
        per = matrix.groupBy("part", "label").agg(F.count("*").alias("c")).groupBy("part")
        per = per.agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("many")).select("part", F.col("x.label").alias("largest"), "many", (F.col("many") - F.col("x.c")).alias("askers"))
        return open_groups(_grid(matrix.join(per, "part").join(home.select("key", "n", "sketch"), "key"), block), threshold, best)

    # bound and open: first the best pair of each two groups, until that merges none
    for _ in range(MERGES):
        admitted = s.save(opened(matrix, True))
        pairs = admitted.groupBy("one", "two").agg(F.max(F.struct("share", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        new = s.save(linked_pairs(s.save(pairs)))
        merged = new.limit(1).count() > 0
        if merged:
            found = s.save(found.unionByName(new))
            now = s.save(components(found, s))
        # parts without an admitted pair are settled for good
        matrix = unsettled(matrix.join(admitted.select("part").distinct(), "part", "left_semi"), now)
        if not merged:
            break
    pairs = s.save(opened(matrix, False).select("a", "b").distinct())
    new = s.save(linked_pairs(pairs))
    if new.limit(1).count():
        now = s.save(components(s.save(found.unionByName(new)), s))

    # the least doc_id of each component; a component may have a large share of all classes, so its key is salted
    root = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(now.withColumnRenamed("node", "key"), "key", "left")
    root = s.save(root.select("key", "least", F.coalesce("root", "key").alias("root"), F.pmod("key", F.lit(SALTS)).alias("salt")))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")).where("many > 1")
    least = least.select("root", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    final = s.save(root.join(least, ["root", "salt"], "left").select("key", F.coalesce("component_id", "least").alias("component_id"), F.col("root").alias("component")))
    s.keep_only(rows, final)
    out = rows.select("doc_id", "text_hash", "n", "key").join(final, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "text_hash")
