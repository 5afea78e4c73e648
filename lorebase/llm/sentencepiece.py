"""SentencePiece encoding and decoding over a lattice of pieces.

The lattice of a word has an edge for every substring of bounded length that
is a piece: substrings are exploded, joined to the piece table on their text
and grouped by word, and a fold over each word's edges gives its pieces.  The
fold follows the model's kind: a unigram model takes the path with the highest
sum of scores (Viterbi), a BPE model merges the adjacent pair with the highest
score until none is left.  (For a BPE model the Viterbi path over its scores
is another segmentation than the model's own, so it is not used there.)

Two forms of it give the same pieces:

* ``lattice_pieces`` does this for a table of distinct words with explode,
  an equi-join, a group and a higher-order ``aggregate``;
* ``encode`` does it for the distinct words of a slice of documents in numpy
  -- the exploded substrings are rows of hashes, the join is a look-up, the
  groups are positions -- so that no word has to be shuffled to its pieces and
  back to its document.  Words met before are kept in a bounded cache.

Words end before a run of spaces and at line breaks, which no piece crosses;
that is checked when a model is read.  Characters without a piece become byte
pieces.  Decoding gives the text back, except that U+2581 is read as a space,
as in the model itself.

Null text has null ids; empty text has none.  Any characters may occur.  Very
long words are merged with a heap.  Repeated rows each get a result; further
columns are carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS, CACHE_BYTES = 250_000, 12 << 20
#: Longer words are merged with a heap.
LONG = 64
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_NONE = np.iinfo(np.int32).max
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A model's pieces: what each id stands for."""

    text: list[str]
    score: list[float]
    normal: list[bool]
    byte_ids: list[int]
    kind: str = "bpe"
    rank: dict[str, int] = field(init=False)
    longest: int = field(init=False)
    _cache: dict = field(default_factory=dict)
    _held: int = 0

    def __post_init__(self):
        order = sorted((i for i, n in enumerate(self.normal) if n), key=lambda i: (-self.score[i], i))
        self.rank = {self.text[i]: r for r, i in enumerate(order)}
        self.ids = np.array(order, dtype=np.int32)
        self.longest = max((len(p) for p in self.rank), default=1)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in self.rank):
            raise ValueError("a piece goes across the end of a word")
        by_length: dict[int, list[str]] = {}
        for p in self.rank:
            by_length.setdefault(len(p), []).append(p)
        hashes = np.zeros(len(order), dtype=np.uint64)
        for n, ps in by_length.items():
            codes = np.array([[ord(c) for c in p] for p in ps], dtype=np.uint64)
            h = np.zeros(len(ps), dtype=np.uint64)
            for k in range(n):
                h = (h + codes[:, k]) * _BASE
            hashes[[self.rank[p] for p in ps]] = mix64(h + np.uint64(n))
        # an open table of two probes: hash -> rank
        bits = 1
        while True:
            bits += 1
            if (1 << bits) < 4 * len(order):
                continue
            one = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            first = np.unique(one, return_index=True)[1]
            rest = np.setdiff1d(np.arange(len(order)), first)
            two = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
            if len(np.unique(two[rest])) == len(rest):
                break
        self.bits = bits
        self.slots = np.full((2, 1 << bits), -1, dtype=np.int32)
        self.slots[0, one[first]] = first
        self.slots[1, two[rest]] = rest
        self.hashes = hashes
        self.out = [b"" if not n else t.replace(SPACE, " ").encode() for t, n in zip(self.text, self.normal)]
        for v, i in enumerate(self.byte_ids):
            self.out[i] = bytes([v])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The rank of the piece with each hash, _NONE without one."""
        a = self.slots[0, (h >> np.uint64(64 - self.bits)).astype(np.int64)]
        b = self.slots[1, (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        r = np.where((a >= 0) & (self.hashes[a] == h), a, np.where((b >= 0) & (self.hashes[b] == h), b, -1))
        return np.where(r >= 0, r, _NONE).astype(np.int32)


def read_model(path: str = MODEL) -> Pieces:
    """The pieces of a SentencePiece model file."""
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    text = [m.id_to_piece(i) for i in range(n)]
    normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
    at = {t: i for i, t in enumerate(text) if m.is_byte(i)}
    scores = [m.get_score(i) for i in range(n)]
    # BPE models number their merges: scores are 0, -1, -2, ...
    kind = "bpe" if all(s == int(s) for s in scores) else "unigram"
    return Pieces(text, scores, normal, [at[f"<0x{v:02X}>"] for v in range(256)], kind)


def _merge_long(word: str, p: Pieces) -> list[str]:
    """The BPE pieces of one word, by a heap of mergeable pairs."""
    sym, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] < len(sym) and (r := p.rank.get(both := sym[i] + sym[right[i]])) is not None:
            heapq.heappush(heap, (r, i, both))

    for i in range(len(sym) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if not sym[i] or right[i] >= len(sym) or sym[i] + sym[right[i]] != both:
            continue
        j = right[i]
        sym[i], sym[j], right[i] = both, "", right[j]
        if right[i] < len(sym):
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [s for s in sym if s]


def _ids_of(pieces: list[str], p: Pieces) -> list[int]:
    out = []
    for s in pieces:
        r = p.rank.get(s)
        out += [p.byte_ids[b] for b in s.encode()] if r is None else [int(p.ids[r])]
    return out


def encode_words(words: list[str], p: Pieces) -> list[list[int]]:
    """The BPE ids of each word."""
    out: list[list[int]] = [[] for _ in words]
    short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
    for i in (i for i, w in enumerate(words) if len(w) > LONG):
        out[i] = _ids_of(_merge_long(words[i], p), p)
    if not short:
        return out
    lens = np.array([len(words[i]) for i in short], dtype=np.int64)
    joined = "".join(words[i] for i in short)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(chars))
    # edges[k, i]: the rank of the piece from i over k + 1 characters
    edges = np.full((p.longest, len(chars)), _NONE, dtype=np.int32)
    h = np.zeros(len(chars), dtype=np.uint64)
    for k in range(p.longest):
        h[: len(chars) - k] = (h[: len(chars) - k] + chars[k:]) * _BASE
        ok = at + k < end
        if not ok.any():
            break
        edges[k, ok] = p.look_up(mix64(h[ok] + np.uint64(k + 1)))
    size = np.ones(len(chars), dtype=np.int64)  # of the symbol that starts here, else 0
    word = np.repeat(np.arange(len(short)), lens)
    live = at
    far = np.int64(1) << 40
    while len(live):
        live = live[size[live] > 0]
        nxt = live + size[live]
        live, nxt = live[nxt < end[live]], nxt[nxt < end[live]]
        if not len(live):
            break
        both = size[live] + size[nxt]
        r = np.where(both <= p.longest, edges[np.minimum(both, p.longest) - 1, live], _NONE).astype(np.int64)
        key = np.where(r < _NONE, (r << 32) | live, far << 20)
        new = np.flatnonzero(np.r_[True, word[live][1:] != word[live][:-1]])
        best = np.minimum.reduceat(key, new)
        go = best < far << 20
        pos = (best[go] & ((1 << 32) - 1)).astype(np.int64)
        eaten = pos + size[pos]
        size[pos] += size[eaten]
        size[eaten] = 0
        counts = np.diff(np.append(new, len(live)))
        live = live[np.repeat(go, counts)]
    start = np.flatnonzero(size > 0)
    rank = edges[size[start] - 1, start]
    ids = np.where(rank < _NONE, p.ids[np.minimum(rank, len(p.ids) - 1)], -1).tolist()
    for s, w, i in zip(start.tolist(), word[start].tolist(), ids):
        if i >= 0:
            out[short[w]].append(i)
        else:
            out[short[w]] += [p.byte_ids[b] for b in joined[s].encode("utf-8", "surrogatepass")]
    return out


def encode_texts(texts: list[str | None], p: Pieces) -> list[np.ndarray | None]:
    """The ids of each text, as the model's own library gives them."""
    units = [None if t is None else _UNIT.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
    cache = p._cache
    if len(cache) > CACHE_WORDS or p._held > CACHE_BYTES:
        cache.clear()
        p._held = 0
    new = list({u for us in units if us for u in us}.difference(cache))
    for a in range(0, len(new), 40_000):
        part = new[a : a + 40_000]
        coded = [np.array(x, dtype=np.int32).tobytes() for x in encode_words(part, p)]
        cache.update(zip(part, coded))
        p._held += sum(map(len, part)) + sum(map(len, coded))
    get = cache.__getitem__
    return [None if us is None else np.frombuffer(b"".join(map(get, us)), dtype=np.int32) for us in units]


def decode_ids(ids, p: Pieces) -> str:
    """The text of a sequence of ids."""
    text = b"".join(map(p.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def encode(docs: DataFrame, p: Pieces, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of ``column`` added; a column of that name is replaced."""
    docs = docs.drop(into)
    held = docs.sparkSession.sparkContext.broadcast(p)
    at = docs.columns.index(column)

    def run(batches):
        for b in slices(batches, column):
            ids = encode_texts(b.column(at).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*b.schema.names, into])

    return docs.mapInArrow(run, f"{_schema(docs)}, `{into}` array<int>")


def decode(rows: DataFrame, p: Pieces, column: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in ``column`` added; a column of that name is replaced."""
    rows = rows.drop(into)
    held = rows.sparkSession.sparkContext.broadcast(p)
    at = rows.columns.index(column)

    def run(batches):
        for b in batches:
            text = [None if i is None else decode_ids(i, held.value) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, type=pa.string())], names=[*b.schema.names, into])

    return rows.mapInArrow(run, f"{_schema(rows)}, `{into}` string")


def op2_report(docs: DataFrame, p: Pieces) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces), ids_sha256 (of the ids as little-endian int32), round_trip of every row."""
    held = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        p = held.value
        byte = np.zeros(len(p.text), dtype=bool)
        byte[p.byte_ids] = True
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, p)
            n = [None if i is None else len(i) for i in ids]
            fallback = [None if i is None else int(byte[i].sum()) for i in ids]
            sha = [None if i is None else hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]
            same = [None if i is None else decode_ids(i, p) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), pa.array(fallback, type=pa.int64()), pa.array(sha, type=pa.string()), pa.array(same, type=pa.bool_())], names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "round_trip"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, round_trip boolean")


def _edge(i, j):
    """The key of the edge from i to j, whatever the word's length."""
    return i.cast("long") * (1 << 31) + j


def lattice_pieces(words: DataFrame, p: Pieces, spark: SparkSession | None = None) -> DataFrame:
    """word, pieces (array of strings) of every distinct ``word``, by relational operations.

    The piece table has as many rows as the vocabulary, so it is broadcast.
    """
    spark = spark or words.sparkSession
    table = spark.createDataFrame([(t, float(p.score[int(p.ids[r])])) for t, r in p.rank.items()], "piece string, score double")
    words = words.select("word").where("word <> ''").distinct()
    n = F.length("word")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, F.least(i + p.longest, n)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )
    spans = words.withColumn("s", F.explode(spans)).withColumn("piece", F.substring("word", F.col("s.i") + 1, F.col("s.j") - F.col("s.i")))
    edges = spans.join(F.broadcast(table), "piece", "left").where("score is not null or s.j = s.i + 1")
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct(_edge(F.col("s.i"), F.col("s.j")).alias("at"), F.coalesce("score", F.lit(-1e12)).alias("score"))).alias("edges"))
    grouped = grouped.withColumn("map", F.map_from_entries("edges"))
    low = F.lit(-1e300)
    if p.kind == "bpe":
        cuts = F.sequence(F.lit(0), n)

        def merge(state, _):
            pairs = F.transform(
                F.sequence(F.lit(0), F.size(state) - 3),
                lambda k: F.struct(F.coalesce(F.try_element_at("map", _edge(F.get(state, k), F.get(state, k + 2))), low).alias("score"), (-k).alias("k")),
            )
            best = F.array_max(pairs)
            k = -best["k"]
            merged = F.concat(F.slice(state, 1, k + 1), F.slice(state, k + 3, F.size(state)))
            return F.when(F.size(state) < 3, state).when(best["score"] == low, state).otherwise(merged)

        bounds = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), cuts, merge)
    else:
        # best[j]: the highest sum of scores of a path to j, and where its last edge starts
        first = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("back")))

        def step(state, j):
            ways = F.transform(
                F.sequence(F.greatest(j - p.longest, F.lit(0)), j - 1),
                lambda i: F.struct((F.get(state, i)["sum"] + F.coalesce(F.try_element_at("map", _edge(i, j)), low)).alias("sum"), i.alias("back")),
            )
            return F.concat(state, F.array(F.array_max(ways)))

        best = F.aggregate(F.sequence(F.lit(1), n), first, step)
        grouped = grouped.withColumn("best", best)
        bounds = F.aggregate(
            F.sequence(F.lit(1), n),
            F.array(n),
            lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(F.col("best"), F.get(path, F.lit(0)))["back"]), path)),
        )
    grouped = grouped.withColumn("bounds", bounds)
    pieces = F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), lambda k: F.substring(F.col("word"), F.get(F.col("bounds"), k) + 1, F.get(F.col("bounds"), k + 1) - F.get(F.col("bounds"), k)))
    return grouped.select("word", pieces.alias("pieces"))
