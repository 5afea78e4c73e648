"""A Merkle manifest of a dataset, with a proof for each row.

Each row is a leaf.  The leaves of a source, in order, make a tree in which
runs of ARITY siblings (the last run may be shorter) become the hash of their
digests; the roots of the sources' trees, in order, make a tree of their own.
Every run's length is known beforehand, from the sizes of the sources.

A part of the rows is a sparse forest: the nodes, by tree, level and index,
whose runs are not complete yet.  Forests merge by union, and a run that is
complete collapses into its parent, which may complete the next one; merging is
associative and commutative, so ``treeReduce`` may merge them in any order, and
a task that is lost is just done again.  Rows are cut into ranges of source and
order, so a part's forest holds only the edges of its range: less than 2 *
ARITY nodes for each level of its first tree, its last tree and the tree of
sources.  What merging collapses is kept as runs: at most one for each border
between parts and level.  So the driver holds ``parts * levels * ARITY``
digests, whatever the number of rows, and that is what is broadcast for the
proofs: with PART_ROWS rows in a part, about 5 kB for each part.

The second pass goes over the same parts.  A row's siblings are in its own part
or in a broadcast run; each proof is folded, from the leaf to be verified up to
the root.

Leaves are ordered by doc_id (null first), equal ones by their digest; sources
by their UTF-8 bytes, null first.  Rows that are equal in all hashed columns are
leaves each, and stay together in one part.  An empty table has no root and no
rows.  Columns that are not hashed are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_of_id

ARITY = 16
#: Rows of a part; a row takes about 100 bytes of a worker while its part is at work.
PART_ROWS = 500_000
#: The number of the tree of sources.
TOP = -1
_SIZE = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(c: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of columns of strings: each its number of bytes, a colon and its value, or a hyphen for null."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case for one doc_id in five; no change elsewhere."""
    return F.when(crc_of_id() % 5 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and changed (the tampered row's leaf, null where nothing is tampered with), as bytes."""
    hashed = lambda text: F.unhex(leaf_of(F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text))
    changed = F.when(crc_of_id() % 5 == 0, hashed(tampered_text()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", hashed(F.col("text")).alias("leaf"), changed.alias("changed"))


def parent_of(run: bytes) -> bytes:
    return hashlib.sha256(run.hex().encode()).digest()


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree with so many leaves; 1 is the root."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def grow(start: int, data: bytes, size: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, bytes]]]:
    """(levels, open) of the leaves from ``start`` on of a tree of ``size``.

    levels: for each level the first index and the digests that the leaves
    alone give.  open: (level, index, digest) of nodes whose run is not
    complete.  A tree that is complete ends with a level of one node and has
    none open.
    """
    levels, rest, n = [], [], size
    while data:
        levels.append((start, data))
        if n == 1:
            break
        end, after = start + len(data) // _SIZE, -(-n // ARITY)
        lo, hi = -(-start // ARITY), after if end == n else end // ARITY
        at = lambda i: min(max(i - start, 0), end - start) * _SIZE
        inside = range(lo, hi)
        edges = [(start, min(lo * ARITY, end)), (max(min(hi * ARITY, end), lo * ARITY), end)] if inside else [(start, end)]
        for a, b in edges:
            rest += [(len(levels) - 1, i, data[at(i) : at(i + 1)]) for i in range(a, b)]
        data, start, n = b"".join(parent_of(data[at(i * ARITY) : at((i + 1) * ARITY)]) for i in inside), lo, after
    return levels, rest


def merge_forests(x: tuple[dict, dict, dict], y: tuple[dict, dict, dict]) -> tuple[dict, dict, dict]:
    """The union of two forests, with what becomes complete collapsed.

    A forest is (nodes, sizes, runs): open digests by (tree, level, index),
    sizes of their trees, and collapsed runs by (tree, level, index of the parent).
    """
    if len(x[0]) < len(y[0]):
        x, y = y, x
    nodes, sizes, runs = x
    nodes.update(y[0])
    sizes.update(y[1])
    runs.update(y[2])
    todo = list(y[0])
    while todo:
        tree, level, i = todo.pop()
        if (tree, level, i) not in nodes:  # collapsed meanwhile
            continue
        n = width(sizes[tree], level)
        if n == 1:
            if tree != TOP:
                nodes[(TOP, 0, tree)] = nodes.pop((tree, level, i))
                todo.append((TOP, 0, tree))
            continue
        p = i // ARITY
        run = [(tree, level, k) for k in range(p * ARITY, min((p + 1) * ARITY, n))]
        if all(k in nodes for k in run):
            runs[(tree, level, p)] = data = b"".join(nodes.pop(k) for k in run)
            nodes[(tree, level + 1, p)] = parent_of(data)
            todo.append((tree, level + 1, p))
    return nodes, sizes, runs


@dataclass
class Part:
    """The rows of a part that belong together, with the trees that they alone give."""

    first: int  # the number of the first source
    bounds: list[int]  # where the sources' rows begin, and the end
    starts: list[int]  # the first row's place in its source
    sizes: list[int]
    trees: list[list[tuple[int, bytes]]]
    top: list[tuple[int, bytes]]
    open: dict


def part_of(codes: np.ndarray, leaf: list[bytes], plan: tuple[int, int, int, int], sources: int) -> Part:
    """codes: equal for neighbours of one source; plan: see ``build``."""
    number, before, first_size, last_size = plan
    bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    lengths = np.diff(bounds).tolist()
    starts, sizes = [0] * len(lengths), list(lengths)
    starts[0], sizes[-1] = before, last_size
    sizes[0] = first_size
    trees, nodes = [], {}
    roots, whole = [], []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        levels, rest = grow(starts[k], b"".join(leaf[a:b]), sizes[k])
        trees.append(levels)
        nodes |= {(number + k, level, i): d for level, i, d in rest}
        if not rest:  # sources that lie within the part follow each other
            whole.append(number + k)
            roots.append(levels[-1][1])
    top, rest = grow(whole[0], b"".join(roots), sources) if whole else ([], [])
    nodes |= {(TOP, level, i): d for level, i, d in rest}
    if top and len(top[-1][1]) == _SIZE and width(sources, len(top) - 1) == 1:
        nodes[(TOP, len(top) - 1, 0)] = top[-1][1]
    return Part(number, bounds, starts, sizes, trees, top, nodes)


def _by_part(batches, work):
    """``work(pid, table)`` for the rows of each pid, which arrive one after another."""
    held, at = [], None
    for batch in batches:
        pids = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(pids)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and pids[a] != at:
                yield from work(int(at), pa.Table.from_batches(held).combine_chunks())
                held = []
            at = pids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(int(at), pa.Table.from_batches(held).combine_chunks())


def _codes(column) -> np.ndarray:
    """A number for each source; sorted rows of one source have the same one."""
    return pa.concat_arrays(column.chunks).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


@dataclass
class Manifest:
    root: str | None
    rows: int
    sources: int
    placed: DataFrame
    #: pid -> number of the first source, rows of it in earlier parts, sizes of the first and of the last source
    plan: dict
    runs: dict


def _arranged(placed: DataFrame, parts: int) -> DataFrame:
    return placed.repartition(parts, "pid").sortWithinPartitions("pid", "source", "doc_id", "leaf").select("pid", "doc_id", "source", "leaf", "changed")


def build(docs: DataFrame, scratch: Scratch, part_rows: int = PART_ROWS) -> Manifest:
    """The manifest of ``docs`` (doc_id, text, lang, source, n_chars)."""
    spark = docs.sparkSession
    rows = scratch.save(leaves(docs))  # the sample of the ranges reads it as well
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // part_rows))
    placed = scratch.save(rows.repartitionByRange(parts, "source", "doc_id", "leaf").withColumn("pid", F.spark_partition_id()))
    scratch.drop(rows)
    if n == 0:
        return Manifest(None, 0, 0, placed, {}, {})
    per = placed.groupBy("pid", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    edge = per.groupBy("pid").agg(F.min(F.struct("key", "n")).alias("lo"), F.max(F.struct("key", "n")).alias("hi"), F.count("*").alias("k"))
    edges = sorted((r.pid, r.lo.key, r.lo.n, r.hi.key, r.hi.n, r.k) for r in edge.collect())  # one row for each part
    total: dict = {}
    for _, lo, n_lo, hi, n_hi, _ in edges:
        total[lo] = total.get(lo, 0) + n_lo
        if hi != lo:
            total[hi] = total.get(hi, 0) + n_hi
    plan, seen, number, last = {}, {}, -1, None
    for pid, lo, n_lo, hi, n_hi, k in edges:
        first = number + (lo != last)
        plan[pid] = (first, seen.get(lo, 0), total[lo], total[hi])
        seen = {hi: n_hi + (seen.get(lo, 0) if hi == lo else 0)}
        number, last = first + k - 1, hi
    sources = number + 1

    def fragments(batches):
        def work(pid, t):
            p = part_of(_codes(t.column("source")), t.column("leaf").to_pylist(), plan[pid], sources)
            trees = {k[0] for k in p.open if k[0] != TOP}
            sizes = {p.first + k: s for k, s in enumerate(p.sizes) if p.first + k in trees} | {TOP: sources}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((p.open, sizes, {}))], type=pa.binary())], names=["forest"])

        yield from _by_part(batches, work)

    forests = scratch.save(_arranged(placed, parts).mapInArrow(fragments, "forest binary"))
    depth = 2 if len(plan) < 4096 else 3
    nodes, _, runs = forests.rdd.map(lambda r: merge_forests(({}, {}, {}), pickle.loads(bytes(r.forest)))).treeReduce(merge_forests, depth)
    scratch.drop(forests)
    if len(nodes) != 1:
        raise RuntimeError(f"{len(nodes)} nodes are left of the forest")
    return Manifest(next(iter(nodes.values())).hex(), n, sources, placed, plan, runs)


class Paths:
    """The siblings of the rows of a part."""

    def __init__(self, part: Part, sources: int, runs: dict):
        self.part, self.sources, self.runs = part, sources, runs
        self._cached: dict = {}

    def size(self, tree: int) -> int:
        return self.sources if tree == TOP else self.part.sizes[tree - self.part.first]

    def run(self, tree: int, level: int, p: int, n: int) -> bytes:
        """The digests of a run, of a level of ``n`` nodes."""
        levels = self.part.top if tree == TOP else self.part.trees[tree - self.part.first]
        lo, hi = p * ARITY, min((p + 1) * ARITY, n)
        if level < len(levels):
            start, data = levels[level]
            if lo >= start and hi <= start + len(data) // _SIZE:
                return data[(lo - start) * _SIZE : (hi - start) * _SIZE]
        return self.runs[(tree, level, p)]

    def steps(self, tree: int, i: int) -> list[tuple[bytes, bytes]]:
        """What stands to the left and to the right of each node on the way up, from the leaf ``i`` of ``tree``; runs of one are a step too."""
        n = self.size(tree)
        if n == 1:
            return self._above(tree, 0, i, n)
        key = (tree, i // ARITY)
        if key not in self._cached:  # neighbours share the rest of the way
            self._cached = {key: self._above(tree, 1, i // ARITY, -(-n // ARITY))}
        return [self._step(tree, 0, i, n), *self._cached[key]]

    def _step(self, tree: int, level: int, i: int, n: int) -> tuple[bytes, bytes]:
        run, k = self.run(tree, level, i // ARITY, n), i % ARITY * _SIZE
        return run[:k], run[k + _SIZE :]

    def _above(self, tree: int, level: int, i: int, n: int) -> list[tuple[bytes, bytes]]:
        out = []
        while n > 1 or tree != TOP:
            if n == 1:
                tree, level, i, n = TOP, 0, tree, self.sources
            else:
                out.append(self._step(tree, level, i, n))
                level, i, n = level + 1, i // ARITY, -(-n // ARITY)
        return out


def fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        digest = parent_of(left + digest + right)
    return digest


def audit(m: Manifest, with_proof: bool = False) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with ``with_proof`` the siblings' digests too, in order, as one text ``proof``."""
    spark = m.placed.sparkSession
    held = spark.sparkContext.broadcast((m.plan, m.runs))
    root, sources, parts = bytes.fromhex(m.root or ""), m.sources, max(1, len(m.plan))
    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proof else [])]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.string()][: len(names)]
    schema = ", ".join(f"{c} {'long' if k == pa.int64() else 'boolean' if k == pa.bool_() else 'string'}" for c, k in zip(names, kinds))

    def run(batches):
        plan, runs = held.value

        def work(pid, t):
            leaf, changed = t.column("leaf").to_pylist(), t.column("changed")
            part = part_of(_codes(t.column("source")), leaf, plan[pid], sources)
            paths = Paths(part, sources, runs)
            for k, (a, b) in enumerate(zip(part.bounds, part.bounds[1:])):
                tree = part.first + k
                top = paths.run(TOP, 0, tree // ARITY, sources) if sources > 1 else root
                subroot = (top[tree % ARITY * _SIZE :][:_SIZE] if sources > 1 else root).hex()
                for lo in range(a, b, 4096):
                    hi, proofs, folded = min(b, lo + 4096), [], []
                    other = changed.slice(lo, hi - lo).to_pylist()
                    for j in range(lo, hi):
                        steps = paths.steps(tree, part.starts[k] + j - a)
                        proofs.append(b"".join(x + y for x, y in steps).hex())
                        folded.append(fold(other[j - lo] or leaf[j], steps))
                    many = hi - lo
                    columns = [t.column(c).slice(lo, many).to_pylist() for c in ("doc_id", "source")]
                    columns += [[x.hex() for x in leaf[lo:hi]], [subroot] * many, [root.hex()] * many, [hashlib.sha256(x.encode()).hexdigest() for x in proofs]]
                    columns += [[x.hex() for x in folded], [x == root for x in folded], *([proofs] if with_proof else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, kinds)], names=names)

        yield from _by_part(batches, work)

    return _arranged(m.placed, parts).mapInArrow(run, schema)


def subroots(m: Manifest) -> DataFrame:
    """source, rows, subroot: the manifest's own lines."""
    return audit(m).groupBy("source").agg(F.count("*").alias("rows"), F.max("subroot").alias("subroot"))


def op11_report(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    return audit(build(docs, scratch)).drop("source")


def _oracle(source_levels: int = 5, top_levels: int = 4) -> str:
    """SQL for sources of up to ARITY ** source_levels rows, and ARITY ** top_levels sources."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    crc = "xor(list_reduce([ord(x) FOR x IN string_split(doc_id::VARCHAR, '')], lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295)"
    parts = [
        "tab AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS tab)",
        f"lf AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f'''translate(text, '{_UPPER}', '{_LOWER}')''')} ELSE {leaf('text')} END AS changed FROM documents, tab)",
        "rows AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER () AS r FROM lf)",
        "a0 AS (SELECT t, i, leaf AS h FROM rows)",
        "p0 AS (SELECT r, t, i, '' AS proof, changed AS h FROM rows)",
    ]

    def level(a: str, p: str, k: int) -> None:
        now, then = f"{a}{k}", f"{a}{k + 1}"
        parts.append(f"{now}w AS (SELECT *, count(*) OVER (PARTITION BY t) AS w FROM {now})")
        parts.append(f"{then} AS (SELECT t, i // {ARITY} AS i, CASE WHEN max(w) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {now}w GROUP BY t, i // {ARITY})")
        parts.append(
            f"{now}s AS (SELECT x.t, x.i, any_value(x.w) AS w, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lo, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS hi FROM {now}w x JOIN {now} y ON y.t = x.t AND y.i // {ARITY} = x.i // {ARITY} GROUP BY x.t, x.i)"
        )
        parts.append(f"{p}{k + 1} AS (SELECT r, t, p.i // {ARITY} AS i, proof || lo || hi AS proof, CASE WHEN w = 1 THEN h ELSE sha256(lo || h || hi) END AS h FROM {p}{k} p JOIN {now}s USING (t, i))")

    for k in range(source_levels):
        level("a", "p", k)
    parts.append(f"b0 AS (SELECT 0 AS t, t AS i, h FROM a{source_levels})")
    parts.append(f"q0 AS (SELECT r, 0 AS t, t AS i, proof, h FROM p{source_levels})")
    for k in range(top_levels):
        level("b", "q", k)
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, b0.h AS subroot, b{top_levels}.h AS root, sha256(proof) AS proof_sha256, q.h AS folded_root, q.h = b{top_levels}.h AS verified
FROM rows JOIN q{top_levels} q USING (r) JOIN b0 ON b0.i = rows.t, b{top_levels}"""
    )


ORACLE = _oracle()
