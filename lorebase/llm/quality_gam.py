"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives FEATURES numbers.  Training cuts every feature into bins at
quantiles and boosts in cycles: feature after feature, a tree of depth two
over its bins is fitted to the current residuals and a fraction of it added to
that feature's table.  Then the pairs of features with the largest gain on
what is left get two-dimensional tables in the same way.  A score is the sum
of one entry per table, found by searchsorted and added for a whole batch.

Training takes a bounded sample of labelled rows and learns from their
features only.  Scoring is one pass without a shuffle over whole texts.

Null and empty texts have all features 0 and are scored like any other.
Repeated rows each get a result.  Null labels and null doc_ids are never
learned from; a null doc_id counts as held out.  Without labels of both kinds
the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, crc_of_id, slices

#: Labelled rows that are learned from, at most: the bound of the sample.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 60, 8, 0.1

FEATURES = (
    "log_words", "word_length", "upper_share", "symbol_share", "bang_share", "bar_share", "digit_share", "stop_share",
    "distinct_share", "top_word_share", "same_as_last", "log_lines", "line_length", "repeated_line_share", "other_share", "long_word_share",
)


def _class_of_byte() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>@^~", "!?", "|", "0123456789", ".,;:'\"()-", " \t\r\x0b\x0c", "\n", "abcdefghijklmnopqrstuvwxyz"), 1):
        out[[ord(c) for c in chars]] = i
    out[128:] = 10
    return out


_CLASS = _class_of_byte()


def features(text: bytes) -> list[float]:
    """FEATURES of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    by = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=11)
    words, lines = text.split(), text.split(b"\n")
    n, chars = max(1, len(words)), max(1, len(text))
    seen = Counter(words)
    again = len(lines) - len(set(lines))
    long = sum(len(w) > 24 for w in seen)
    return [
        float(np.log1p(len(words))), (chars - by[7] - by[8]) / n, by[1] / chars, by[2] / chars, by[3] / chars, by[4] / chars, by[5] / chars, by[6] / chars,
        len(seen) / n, max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n, float(np.log(len(lines))), chars / len(lines) / 1000,
        again / len(lines), (by[0] + by[10]) / chars, long / max(1, len(seen)),
    ]


def _leaf_cuts(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """The value of a depth-two tree over ordered bins, by bin."""

    def split(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        if b - a < 2:
            return 0.0, b
        left, right = g[:-1] ** 2 / (h[:-1] + ridge), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
        gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    n = len(grad)
    gain, mid = split(0, n)
    edges = [0, n]
    if gain > 0:
        edges = sorted({0, n, mid, *(e for g, e in (split(0, mid), split(mid, n)) if g > 0)})
    out = np.empty(n)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree over a grid that cuts rows once and then each side's columns once: its gain and values."""
    g, h = np.cumsum(grad, 1), np.cumsum(hess, 1)
    best, value = 0.0, np.zeros(grad.shape)
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    for r in range(1, grad.shape[0]):
        gain, cuts = -whole, []
        for a, b in ((0, r), (r, grad.shape[0])):
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            part = gs[:-1] ** 2 / (hs[:-1] + ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + ridge)
            c = int(np.argmax(part))
            gain += part[c]
            cuts.append((a, b, c + 1))
        if gain > best:
            best, value = gain, np.zeros(grad.shape)
            for a, b, c in cuts:
                for lo, hi in ((0, c), (c, grad.shape[1])):
                    value[a:b, lo:hi] = grad[a:b, lo:hi].sum() / (hess[a:b, lo:hi].sum() + ridge)
    return best, value


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="lower"))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Model:
    n1 = float(y.sum())
    share = n1 / len(y) if len(y) else 0.5
    if not 0 < share < 1:
        return Model(base=30.0 if share == 1 else -30.0 if len(y) else 0.0)
    base = float(np.log(share / (1 - share)))
    d = x.shape[1]
    model = Model(base, [_edges(x[:, j], BINS) for j in range(d)], coarse=[_edges(x[:, j], PAIR_BINS) for j in range(d)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), base)
    prob = lambda: 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for j in range(d):
            p = prob()
            k = len(model.tables[j])
            step = RATE * _leaf_cuts(np.bincount(at[j], y - p, k), np.bincount(at[j], p * (1 - p), k), ridge)
            model.tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(i: int, j: int):
        p, shape = prob(), (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = low[i] * shape[1] + low[j]
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)

    gains = sorted(((_pair_tree(*grid(i, j)[1:], ridge)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    chosen = [(i, j) for g, i, j in gains[:PAIRS] if g > 0]
    tables = {c: np.zeros((len(model.coarse[c[0]]) + 1, len(model.coarse[c[1]]) + 1)) for c in chosen}
    for _ in range(PAIR_ROUNDS):
        for c in chosen:
            cell, g, h = grid(*c)
            step = RATE * _pair_tree(g, h, ridge)[1]
            tables[c] += step
            z += step.ravel()[cell]
    model.pairs = [(*c, t) for c, t in tables.items()]
    return model


def feature_rows(docs: DataFrame, keep: str) -> DataFrame:
    """The column ``keep`` and an array of FEATURES of every row."""
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "_text"):
            x = pa.array([features(t) for t in byte_texts(b.column(1))], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=[keep, "x"])

    return docs.select(keep, F.col("text").alias("_text")).mapInArrow(run, f"`{keep}` {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, usable, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows that ``usable`` (a condition on doc_id) admits; of a doc_id that repeats, the least text counts."""
    ok = labels.where("doc_id is not null and quality in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not ids:
        return Model(base=0.0)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, int(r.quality)) for r in ids], "id long, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(F.struct("doc_id", "quality").alias("row"), "text")
    got = sorted((r.row.doc_id, r.row.quality, *r.x) for r in feature_rows(rows, "row").collect())
    a = np.array(got, dtype=float).reshape(-1, 2 + len(FEATURES))
    return fit(a[:, 2:], a[:, 1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in slices(batches, "_text"):
            x = np.array([features(t) for t in byte_texts(b.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text _text").mapInArrow(run, "doc_id long, score double")


def op3_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rest = crc_of_id() % 5
    model = train(docs, labels, rest != 0)
    held = F.coalesce(rest == 0, F.lit(True))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
