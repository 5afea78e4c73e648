"""Removing long repeated passages by a prefix-free parse of the corpus.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere.

* Parse.  A rolling hash picks triggers: the start of a window is parsed to
  the trigger that the first REACH positions of the window have least (the
  last one of equals).  A trigger so depends on the window's own bytes alone,
  equal windows have equal triggers, and the starts with one trigger are a
  run.  A phrase is the bytes that the windows of such a run span.
* Dictionary.  Distinct phrases, with the number of times that the parse has
  each.  A phrase found twice settles all its windows; a phrase whose trigger
  string (the bytes that all its windows share) is found once settles them
  too: none repeats.
* Suffix arrays.  What is left are phrases at the edges of repeated passages:
  found once, but with a trigger string that others have.  They and one copy of
  each other phrase with that trigger string go to one task, which sorts the
  suffixes of their bytes to depth LENGTH by doubling ranks.  Equal windows
  have one trigger string, so these buckets together hold the part of the
  corpus order that matters: suffixes of one rank, each as often as the parse
  has its phrase, are the windows that repeat.  Ranks compare bytes, not
  hashes.
* A trigger string with more than BUCKET distinct phrases (the edges of a
  passage that very many texts share) is one range of the order that no task
  should hold.  Its windows are counted by two hashes of 64 bits each, in a
  shuffle with map-side counts.

Trigger strings and phrases are told apart by a hash of 64 bits each, of
different bytes, so two phrases are confused only if both agree; the hash is a
polynomial over random byte values.

Tasks get filters of FILTER_BITS bits that tell them which phrases and windows
cannot matter.  They only save shuffles: whatever passes is joined exactly.

Texts are UTF-8 bytes; null is empty; texts shorter than LENGTH keep all.
Equal texts have equal results, which is how spans find their rows, whatever
doc_ids repeat or are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_texts, mix64, slices

LENGTH = 200
#: A trigger is found among so many positions, by the hash of so many bytes.
REACH, GRAM = 128, 16
#: Texts are parsed in pieces of about so many bytes; a longer text is cut, and no window is lost or found twice.
PIECE = 1 << 19
#: Distinct phrases with one trigger string that one task sorts.
BUCKET = 4096
#: Places that a task remembers, so that copies of a text are not sent again.
SEEN = 500_000
#: Bytes of phrases that are sorted at a time, unless one trigger string has more.
SORTED_BYTES = 1 << 20
#: A trigger's position in a piece is packed below its hash; a piece holds fewer bytes than these bits count.
POSITION_BITS = 24
#: Bits of the filter that tells tasks which phrases to take apart (16 MB).
FILTER_BITS = 27

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: op7 in SQL: every window by the hash of its bytes, in hexadecimal.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d)),
again AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1),
starts AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM w WHERE x IN (SELECT x FROM again)),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM starts),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY doc_id, k),
gaps AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS before FROM spans s JOIN d USING (doc_id)),
per AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last, string_agg(before, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)
"""


class Parsed:
    """The phrases of a piece of the corpus."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, offsets: np.ndarray | int = 0):
        """offsets: where in its whole text each of ``texts`` starts."""
        reach = min(REACH, length // 2)
        gram = min(GRAM, length - reach)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(lens) - lens
        #: Where each whole text would start, so that places are counted from there.
        self.origin = self.begin - offsets
        n = len(data)
        if n > 1 << POSITION_BITS:
            raise ValueError(f"{n} bytes at once, but positions have {POSITION_BITS} bits")
        power = np.full(n + 1, _BASE)
        power[0] = 1
        np.cumprod(power, out=power)
        back = np.full(n + 1, _INVERSE)
        back[0] = 1
        np.cumprod(back, out=back)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * power[:-1], out=self.sums[1:])
        self.back = back
        del power
        starts = np.maximum(0, lens - length + 1)  # windows of each text
        self.empty = not starts.any()
        if self.empty:
            return
        doc = np.repeat(np.arange(len(texts)), starts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + self.begin[doc]
        grams = np.arange(max(0, n - gram + 1))
        key = mix64(self.hash(grams, grams + gram))
        mask = np.uint64((1 << POSITION_BITS) - 1)
        least = (key & ~mask) | (mask - grams.astype(np.uint64))
        width = 1
        while width < reach:  # the least of each ``reach`` positions, by doubling
            step = min(width, reach - width)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            width += step
        trigger = (mask - (least[at] & mask)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[first[1:], len(doc)] - 1
        self.doc, self.lo, self.hi = doc[first], at[first], at[last]
        trigger = trigger[first]
        self.data = data
        self.anchor = mix64(self.hash(trigger, trigger + length - reach + 1) + np.uint64(1))
        self.phrase = mix64(self.hash(self.lo, self.hi + length) ^ mix64((trigger - self.lo).astype(np.uint64) + np.uint64(7)) + (self.hi - self.lo).astype(np.uint64))
        self.length = length

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The polynomial hash of the bytes from a up to b."""
        return (self.sums[b] - self.sums[a]) * self.back[a]


def pieces(texts: list[bytes], length: int = LENGTH, limit: int | None = None):
    """(parts, number of each one's text, offset in it), each of at most ``limit`` + ``length`` bytes.

    Parts of one text overlap by length - 1 bytes: every window starts in exactly one of them.
    A run of starts that is cut gives two phrases with one trigger string, whose windows are then compared one by one.
    """
    limit = max(limit or PIECE, 1)
    parts, of, offsets, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), limit):
            part = t[a : a + limit + length - 1]
            if parts and size + len(part) > limit + length:
                yield parts, np.array(of), np.array(offsets, dtype=np.int64)
                parts, of, offsets, size = [], [], [], 0
            parts.append(part)
            of.append(i)
            offsets.append(a)
            size += len(part)
    if parts:
        yield parts, np.array(of), np.array(offsets, dtype=np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parse(docs: DataFrame, length: int, emit, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        seen: set = set()
        for b in slices(batches, "text", PIECE):
            for texts, of, offsets in pieces(byte_texts(b.column(0)), length):
                p = Parsed(texts, length, offsets)
                if not p.empty and (out := emit(p, b.column(1).to_numpy()[of], seen)) is not None:
                    yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("text", "text_hash").mapInArrow(run, schema)


def phrase_keys(docs: DataFrame, length: int) -> DataFrame:
    """anchor, phrase of every phrase."""
    return _parse(docs, length, lambda p, *_: [_signed(p.anchor), _signed(p.phrase)], "anchor long, phrase long")


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix64(h.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _place(phrase: np.ndarray, text_hash: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of a phrase at a place."""
    return phrase.view(np.uint64) ^ mix64(text_hash.view(np.uint64) + np.uint64(3)) + mix64(lo.astype(np.uint64))


def _passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = _bit(h)
    return ((known[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).astype(bool)


def filter_of(rows: DataFrame, *columns: str) -> np.ndarray:
    """A filter of one hash (or of the places: phrase, text_hash, lo) of ``rows``: 2**FILTER_BITS bits, however many rows."""

    def run(batches):
        for b in batches:
            v = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            bit = _bit(v[0] if len(v) == 1 else _place(*v))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(np.int64(1) << (bit & 31))], names=["word", "bits"])

    words = rows.select(*columns).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[np.array(words.column(0), dtype=np.int64)] = np.array(words.column(1), dtype=np.int64).astype(np.uint32)
    return out


def phrases(docs: DataFrame, anchors: np.ndarray, length: int) -> DataFrame:
    """anchor, phrase, text_hash, lo, hi of the phrases whose anchor passes a filter; their windows start from lo to hi in the text."""
    held = docs.sparkSession.sparkContext.broadcast(anchors)

    def emit(p, text_hash, _):
        own = np.flatnonzero(_passes(held.value, p.anchor))
        begin = p.origin[p.doc[own]]
        return [_signed(p.anchor[own]), _signed(p.phrase[own]), pa.array(text_hash[p.doc[own]]), pa.array(p.lo[own] - begin), pa.array(p.hi[own] - begin)]

    return _parse(docs, length, emit, "anchor long, phrase long, text_hash long, lo long, hi long")


def bodies(docs: DataFrame, places: np.ndarray, length: int) -> DataFrame:
    """anchor, text_hash, lo, body of the phrases at places in a filter: the bytes that their windows span.

    Copies of a text have equal places; a task gives most of them once.
    """
    held = docs.sparkSession.sparkContext.broadcast(places)

    def emit(p, text_hash, seen):
        place = _place(p.phrase, text_hash[p.doc], p.lo - p.origin[p.doc])
        own = np.flatnonzero(_passes(held.value, place))
        own = own[[x not in seen for x in place[own].tolist()]] if len(own) else own
        if not len(own):
            return None
        if len(seen) < SEEN:
            seen.update(place[own].tolist())
        body = [p.data[x : y + length].tobytes() for x, y in zip(p.lo[own].tolist(), p.hi[own].tolist())]
        return [_signed(p.anchor[own]), pa.array(text_hash[p.doc[own]]), pa.array(p.lo[own] - p.origin[p.doc[own]]), pa.array(body, type=pa.binary())]

    return _parse(docs, length, emit, "anchor long, text_hash long, lo long, body binary")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position of ``data`` (bytes) by the ``length`` bytes from it; equal ranks are equal bytes.

    A suffix array to that depth, by doubling; positions less than ``length`` from the end read zeros there.
    """
    n = len(data)
    data = np.concatenate([data, np.zeros(length, dtype=np.uint8)]).astype(np.uint64)
    depth = 1
    while depth * 2 <= min(length, 8):
        depth *= 2
    first = np.zeros(n + length - depth + 1, dtype=np.uint64)
    for k in range(depth):
        first = (first << np.uint64(8)) | data[k : len(first) + k]
    _, rank = np.unique(first, return_inverse=True)
    while depth < length:
        step = min(depth, length - depth)
        both = (rank[: len(rank) - step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        _, rank = np.unique(both, return_inverse=True)
        depth += step
    return rank[:n]


def repeated_starts(body: list[bytes], length: int) -> list[np.ndarray]:
    """For each phrase's bytes, which of its windows start elsewhere too."""
    size = np.array([len(x) for x in body], dtype=np.int64)
    begin = np.cumsum(size) - size
    many = size - length + 1
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    rank = suffix_ranks(np.frombuffer(b"".join(body), dtype=np.uint8), length)[at]
    return np.split(np.bincount(rank)[rank] > 1, np.cumsum(many)[:-1])


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of true."""
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def sorted_edges(rows: DataFrame, length: int) -> DataFrame:
    """text_hash, lo, hi: runs of windows that repeat, among the phrases (anchor, text_hash, lo, body) of each trigger string."""

    def run(batches):
        held, size, last = [], 0, None

        def out():
            text_hash, lo, hi = [], [], []
            for (h, first, _), on in zip(held, repeated_starts([x for _, _, x in held], length)):
                x, y = _runs(on)
                text_hash.append(np.full(len(x), h))
                lo.append(x + first)
                hi.append(y + first)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (text_hash, lo, hi)], names=["text_hash", "lo", "hi"])

        for b in batches:
            for anchor, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same place, in a copy of the text
                if anchor != last and size >= SORTED_BYTES:
                    yield out()
                    held, size = [], 0
                last = anchor
                held.append(row)
                size += len(row[2])
        if held:
            yield out()

    return rows.select("anchor", "text_hash", "lo", "body").repartition("anchor").sortWithinPartitions("anchor", "text_hash", "lo").mapInArrow(run, "text_hash long, lo long, hi long")


def counted_edges(rows: DataFrame, length: int, s: Scratch) -> DataFrame:
    """As ``sorted_edges``, by counts of window hashes: no task holds a trigger string's phrases."""

    def run(batches):
        for b in slices(batches, "body", SORTED_BYTES):
            body = b.column(2).to_pylist()
            data = np.frombuffer(b"".join(body), dtype=np.uint8)
            size = np.array([len(x) for x in body], dtype=np.int64)
            many = size - length + 1
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = inner + np.repeat(np.cumsum(size) - size, many)
            w = []
            for base in (_BASE, mix64(np.array([_BASE]))[0] | np.uint64(1)):
                h, x = np.zeros(len(at), dtype=np.uint64), _VALUE[data]
                for k in range(length):
                    h = h * base + x[at + k]
                w.append(_signed(mix64(h)))
            yield pa.RecordBatch.from_arrays([*w, pa.array(np.repeat(b.column(0).to_numpy(), many)), pa.array(inner + np.repeat(b.column(1).to_numpy(), many))], names=["w1", "w2", "text_hash", "at"])

    found = s.save(rows.select("text_hash", "lo", "body").mapInArrow(run, "w1 long, w2 long, text_hash long, at long"))
    same = found.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    return found.join(same, ["w1", "w2"], "left_semi").select("text_hash", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """text_hash, runs: for each text with repeats, the starts (from, to) of windows that also start elsewhere; a written table.

    docs: text, text_hash.
    """
    s = Scratch(docs.sparkSession)
    by = phrase_keys(docs, length).groupBy("anchor").agg(F.count("*").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"))
    again = s.save(by.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")))
    rows = s.save(phrases(docs, filter_of(again, "anchor"), length).join(again, "anchor"))
    whole = rows.where("not mixed").select("text_hash", "lo", "hi")
    # groups of phrases that share a trigger string: what each phrase is and how often it is found
    kinds = s.save(rows.where("mixed").groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "lo", "hi")).alias("at")))
    twice = kinds.where("n > 1").select("anchor", "phrase")
    whole = whole.unionByName(rows.where("mixed").join(twice, ["anchor", "phrase"], "left_semi").select("text_hash", "lo", "hi"))
    edges = s.save(kinds.groupBy("anchor").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("least = 1").select("anchor", (F.col("many") > bucket).alias("large")))
    apart = kinds.join(edges.select("anchor"), "anchor", "left_semi").select("phrase", "at.text_hash", "at.lo")
    # every row is a phrase of the corpus at its place, so equal windows of two places are a repeat, whatever else
    # passed the filter; two rows of one place are of a text with copies, whose phrases all repeat
    body = s.save(bodies(docs, filter_of(apart, "phrase", "text_hash", "lo"), length))
    large = edges.where("large").select("anchor")
    if large.limit(1).count():
        edge = sorted_edges(body.join(large, "anchor", "left_anti"), length).unionByName(counted_edges(body.join(large, "anchor", "left_semi"), length, s))
    else:
        edge = sorted_edges(body, length)
    out = s.save(whole.unionByName(edge).distinct().groupBy("text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    s.keep_only(out)
    return out


def spans_of(runs, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal spans of bytes that the windows starting in ``runs`` cover."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, min(b, size)) for a, b in out]


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed (start, end)), kept (binary) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    runs = repeated_runs(rows.where(F.octet_length("text") >= length).select("text", "text_hash"), length)
    both = rows.join(runs.withColumnRenamed("text_hash", "h"), F.col("text_hash") == F.col("h"), "left").select("doc_id", "text", "runs")

    def run(batches):
        for b in slices(batches, "text"):
            texts, out, kept = byte_texts(b.column(1)), [], []
            for t, r in zip(texts, b.column(2).to_pylist()):
                s = spans_of([(x["lo"], x["hi"]) for x in r], len(t), length) if r else []
                a, parts = 0, []
                for lo, hi in s:
                    parts.append(t[a:lo])
                    a = hi
                out.append([{"start": lo, "end": hi} for lo, hi in s])
                kept.append(b"".join(parts) + t[a:])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(out, type=kind), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op7_report(docs: DataFrame) -> DataFrame:
    r = without_repeats(docs)
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
