"""Toxicity by a subsequence string kernel with Nystroem landmarks.

The kernel compares two short strings by the three-character subsequences
they share; a subsequence that is spread over ``s`` characters weighs
``DECAY**s``, so ``i.diot`` or ``idxiot`` stays close to ``idiot``.  Strings
are windows of WINDOW characters over a word (its ends marked), and the
normalised kernel is raised to POWER.

Training takes labelled texts, a bounded sample, apart into sentences.  Only
whole texts have labels, so sentences get theirs by a greedy cover: it finds
the word beginnings and words that explain the toxic texts while (almost) no
clean text has them.  A piece explains a text either by being there (an
insult that clean texts do not use) or by being dense there (at least twice
and in DENSE of the words: clean texts have the same beginnings now and then).
Sentences of toxic texts that hold a piece which explains their text are
positive, all sentences of clean texts negative, the others have no label.
Words that stand at a piece in a positive sentence are positive examples,
words of negative sentences negative ones, those closest to the landmarks
first.  Landmarks are taken from the positive windows; two linear SVMs on the
Nystroem features, one for each way to explain, are a weight per landmark.  A
text's score is a logistic function of its highest insult value, the number
of words above HIT, and the share of dense words, all over the words as they
stand in the text, fitted on labelled texts that the cover did not see.

The sample is fitted in one task and comes back as a model of bounded size, so
the driver holds no texts.

Scoring is one pass without a shuffle.  A word is scored once per worker (a
bounded cache); texts are read whole.  Runs of single characters
(``i d i o t``) are joined to one word first.

Null or empty text is scored as a text without words.  Repeated rows each get
a result.  Without labels of both kinds the score is the share of toxic
labels (0 without labels).  Null labels and null doc_ids are never learned
from; a null doc_id counts as held out.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, slices

#: Toxic and clean labelled texts that are learned from, and their characters, at most: the bound of the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 6000, 48 << 20
THRESHOLD = 0.7
WINDOW, DECAY, POWER, MAX_GAP = 10, 0.6, 2, 4
MAX_LANDMARKS = 64
#: Pieces that the cover may choose, and how many of them explain a text.
MAX_PIECES, NEED = 48, 5
#: Words that are kept with their values, and their characters.
CACHE_WORDS, CACHE_CHARS = 300_000, 12 << 20
#: Windows whose kernel values are computed together, and that are held together.
KERNEL_ROWS, WINDOW_ROWS = 5_000, 20_000
#: SVM values: from which a word counts, as an insult and as one of a dense piece; beyond which it is no more toxic.
HIT, DENSE_HIT, TOP = 1.0, 0.0, 2.0
#: The share of words from which a piece is dense.
DENSE = 0.01
#: Examples: the most frequent words of a piece, words of clean sentences before and after the closest are chosen.
PIECE_WORDS, CLEAN_WORDS, CLEAN_EXAMPLES = 200, 250_000, 20_000

_STEPS = [(a, b) for b in range(2, MAX_GAP + 1) for a in range(1, b)]
_CODES = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_LOOKS = str.maketrans("0134578@$", "oieastbas")
_EDGE, _MARK = 31, 30


def char_codes(word: str) -> list[int]:
    """Letters 1 to 26, other letters 27 to 29, the rest 30, between edge marks 31."""
    get = _CODES.get
    return [_EDGE, *(get(c) or (27 + ord(c) % 3 if c.isalpha() else _MARK) for c in word.translate(_LOOKS)), _EDGE]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without outer punctuation; runs of three or more single characters are one word."""
    if not text:
        return []
    words = text.lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    if len(single) >= 3:
        run = [i for a, i, b in zip(single, single[1:], single[2:]) if b - a == 2]
        if run:
            at = {j for i in run for j in (i - 1, i, i + 1)}
            out, held = [], []
            for i, w in enumerate(words):
                if i in at:
                    held.append(w)
                    if i + 1 not in at:
                        out.append("".join(held))
                        held = []
                else:
                    out.append(w)
            words = out
    return words


def word_codes(word: str) -> list[int]:
    return char_codes(word.strip(".,;:!?\"'()[]{}*#&%~_-|<>+=/\\"))


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every window (rows of WINDOW, 0 behind the end) and the number of each one's word."""
    return windows_of([word_codes(w) for w in words])


def windows_of(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``, for words as codes."""
    lens = np.array([len(c) for c in codes], dtype=np.int64)
    flat = np.zeros(int(lens.sum()) + WINDOW, dtype=np.int64)
    flat[: len(flat) - WINDOW] = np.fromiter((x for c in codes for x in c), dtype=np.int64, count=int(lens.sum()))
    ends = np.cumsum(lens)
    many = np.maximum(1, lens - WINDOW + 1)
    of = np.repeat(np.arange(len(codes)), many)
    first = np.repeat(ends - lens, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < ends[of][:, None], flat[at], 0), of


def subsequences(win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x n) codes of gapped three-character subsequences, -1 if none, and their n weights."""
    parts, weights = [], []
    for a, b in _STEPS:
        x, y, z = win[:, : WINDOW - b], win[:, a : WINDOW - b + a], win[:, b:]
        parts.append(np.where((z > 0) & (y > 0) & (x > 0), (x << 10) | (y << 5) | z, -1))
        weights += [DECAY ** (b + 1)] * (WINDOW - b)
    return np.concatenate(parts, axis=1), np.array(weights)


def self_kernel(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """K(w, w): squared sums of the weights of each distinct subsequence."""
    order = np.argsort(codes, axis=1, kind="stable")
    c = np.take_along_axis(codes, order, 1)
    w = np.where(c >= 0, weights[order], 0.0)
    new = np.ones(c.shape, dtype=bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, w.ravel())
    return np.bincount(np.repeat(np.arange(len(c)), c.shape[1])[new.ravel()], sums**2, len(c))


@dataclass
class Kernel:
    """Normalised kernel to a set of landmark windows, as one table by subsequence."""

    landmarks: np.ndarray
    slot: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        codes, weights = subsequences(self.landmarks)
        norm = np.sqrt(self_kernel(codes, weights))
        seen = np.unique(codes[codes >= 0])
        self.slot = np.full(1 << 15, -1, dtype=np.int32)
        self.slot[seen] = np.arange(len(seen))
        self.table = np.zeros((len(seen), len(self.landmarks)), dtype=np.float32)
        for z in range(len(codes)):
            ok = codes[z] >= 0
            np.add.at(self.table[:, z], self.slot[codes[z][ok]], weights[ok] / norm[z])

    def __call__(self, win: np.ndarray) -> np.ndarray:
        """(rows x landmarks) kernel values."""
        out = np.zeros((len(win), len(self.landmarks)))
        for a in range(0, len(win), KERNEL_ROWS):
            codes, weights = subsequences(win[a : a + KERNEL_ROWS])
            slots = np.where(codes >= 0, self.slot[codes], -1)
            rows, cols = np.nonzero(slots >= 0)
            k = np.zeros((len(codes), len(self.landmarks)), dtype=np.float32)
            if len(rows):
                new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                k[rows[new]] = np.add.reduceat(self.table[slots[rows, cols]] * weights[cols, None].astype(np.float32), new, axis=0)
            norm = np.sqrt(self_kernel(codes, weights))
            out[a : a + len(codes)] = (k / np.maximum(norm, 1e-9)[:, None]) ** POWER
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last coefficient is the bias. y: -1 or 1."""
    x = np.c_[x, np.ones(len(x))]
    v = np.zeros(x.shape[1])
    for _ in range(30):
        short = 1 - y * (x @ v)
        on = short > 0
        xo, wo = x[on], weight[on]
        grad = ridge * v - xo.T @ (wo * y[on] * short[on])
        step = np.linalg.solve(ridge * np.eye(len(v)) + (xo * wo[:, None]).T @ xo, grad)
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    return v


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    v = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * v
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(v))
        step = np.linalg.solve(h, grad)
        v -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return v


_OUTER = ".,;:!?\"'()[]{}*#&%~_-|<>+=/\\"


@dataclass
class Model:
    base: float
    kernel: Kernel | None = None
    #: (landmarks x 2) weights and two biases: insults, dense words.
    alpha: np.ndarray | None = None
    bias: np.ndarray | None = None
    link: np.ndarray | None = None

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.value = np.empty((0, 2), dtype=np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words x 2) the highest SVM values of each word's windows."""
        out = np.full((len(words), 2), -np.inf)

        def take(held):
            win, of = windows_of([c for _, c in held])
            f = self.kernel(win) @ self.alpha + self.bias
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            np.maximum.at(out, np.array([i for i, _ in held])[of[first]], np.maximum.reduceat(f, first, axis=0))

        held, rows = [], 0
        for i, w in enumerate(words):
            codes = word_codes(w)
            for a in range(0, max(1, len(codes) - WINDOW + 1), WINDOW_ROWS):  # a long word's windows, in pieces
                held.append((i, codes[a : a + WINDOW_ROWS + WINDOW - 1]))
                rows += max(1, len(held[-1][1]) - WINDOW + 1)
                if rows >= WINDOW_ROWS:
                    take(held)
                    held, rows = [], 0
        if held:
            take(held)
        return out

    def features(self, texts: list[list[str]]) -> np.ndarray:
        """For each text, given as words: highest insult value, log of the words above HIT, log of the share of dense words after the first."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        new = list({w for t in texts for w in t}.difference(self.known))
        if new:
            self.value = np.concatenate([self.value, self.word_scores(new).astype(np.float32)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.chars += sum(map(len, new))
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            if not t:
                out[i, 0] = min(TOP, float(self.bias[0]))
                continue
            v = self.value[np.fromiter(map(self.known.__getitem__, t), dtype=np.int64, count=len(t))]
            top = min(TOP, float(v[:, 0].max()))  # far beyond the margin is no more toxic
            dense = np.count_nonzero((v[:, 1] > DENSE_HIT) & (v[:, 0] <= HIT))
            out[i] = top, math.log1p(np.count_nonzero(v[:, 0] > HIT)) if top > HIT else 0.0, math.log1p(max(0, dense - 1) / len(t) / DENSE)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.base)
        x = self.features([words_of(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.link[:-1] + self.link[-1], -30, 30)))


def bare(word: str) -> str:
    return word.strip(_OUTER)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence without outer punctuation; a line's end also ends a sentence."""
    out = []
    for line in text.split("\n"):
        held: list[str] = []
        for w in words_of(line):
            if x := bare(w):
                held.append(x)
            if w[-1] in ".!?" and held:
                out.append(held)
                held = []
        if held:
            out.append(held)
    return out


def _pieces(word: str) -> list[str]:
    """What the cover can choose: a word's beginnings, and the word itself."""
    return [*("^" + word[:n] for n in range(3, 8) if len(word) >= n), "^" + word + "$"]


def dense_pieces(words: Counter, among: set[str] | None = None) -> set[str]:
    """The beginnings that a text has twice or more and in DENSE of its words."""
    total = sum(words.values())
    count = Counter()
    for w, n in words.items():
        if among is None or w[:4] in among:
            for k in range(4, 8):
                if len(w) > k:
                    count["^" + w[:k]] += n
    return {p for p, n in count.items() if n >= 2 and n >= DENSE * total}


def greedy_cover(toxic: list[Counter], clean: list[Counter]) -> list[tuple[str, bool, set[int]]]:
    """(piece, dense, texts) of pieces that explain toxic texts, with all texts that each one explains.

    A text is explained by NEED pieces.  Copies of a text count once: a piece
    must be found in several texts that differ in their least hashed words.
    Of pieces that explain nearly as much, the longest is taken.
    """
    had = {w for t in clean for w in t}
    texts = defaultdict(set)
    for i, t in enumerate(toxic):
        for p in {p for w in t if w not in had for p in _pieces(w)}:
            texts[p, False].add(i)
        for p in dense_pieces(t):
            texts[p, True].add(i)
    least = max(3, len(toxic) // 100)
    texts = {p: s for p, s in texts.items() if len(s) >= (max(4, 3 * least) if p[1] else least)}
    marks = []
    for t in toxic:
        own = [w for w in t if w not in had]
        if len(own) < 5:  # too few words to tell copies by
            own = [" ".join(sorted(t))]
        marks.append([min(zlib.crc32(f"{k}{w}".encode()) for w in own) for k in "abcd"])
    texts = {p: s for p, s in texts.items() if max(len({marks[i][k] for i in s}) for k in range(4)) >= max(least, 0.5 * len(s))}
    against = Counter()
    firsts, dense = {p[1:4] for p, d in texts if not d}, {p[1:5] for p, d in texts if d}
    for t in clean:
        against.update({(p, False) for w in t if w[:3] in firsts for p in _pieces(w) if (p, False) in texts})
        against.update({(p, True) for p in dense_pieces(t, dense) if (p, True) in texts})
    scale = len(toxic) / max(1, len(clean))
    texts = {p: s for p, s in texts.items() if against[p] * scale <= 0.1 * len(s)}
    need = dict.fromkeys(range(len(toxic)), NEED)
    out = []
    while texts and len(out) < MAX_PIECES:
        gain = {p: sum(need[i] > 0 for i in s) - 3 * against[p] * scale for p, s in texts.items()}
        most = max(gain.values())
        if most < least:
            break
        order = lambda p: (not p[1], len(p[0]), gain[p], p[0])
        best = max(gain, key=lambda p: (gain[p], *order(p)))
        like = [p for p in gain if gain[p] >= 0.9 * most and len(texts[p] & texts[best]) >= 0.9 * len(texts[p])]
        best = max(like, key=order)
        out.append((*best, texts[best]))
        for i in texts[best]:
            need[i] -= need[i] > 0
        gone = texts[best]
        texts = {p: s for p, s in texts.items() if gain[p] >= least and not (p[0][:3] == best[0][:3] and len(s & gone) >= 0.8 * len(s))}
    return out


def _first_windows(words: list[str]) -> np.ndarray:
    win, of = windows(words)
    return win[np.r_[True, of[1:] != of[:-1]]]


def _closest(kernel: Kernel, win: np.ndarray, n: int) -> np.ndarray:
    """The kernel values of the n windows that are closest to a landmark, in pieces."""
    best = np.empty((0, len(kernel.landmarks)))
    for a in range(0, len(win), 20_000):
        best = np.concatenate([best, kernel(win[a : a + 20_000])])
        best = best[np.argsort(-best.max(axis=1), kind="stable")[:n]]
    return best


def _svm_of(positive: np.ndarray, negative: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per landmark and the bias; positive, negative: kernel values of the examples."""
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[np.full(len(positive), 1 / max(1, len(positive))), np.full(len(negative), 30 / max(1, len(negative)))] * 1000
    v = _svm(np.concatenate([positive, negative]) @ root, y, weight)
    return root @ v[:-1], float(v[-1])


def fit(texts: list[tuple[str, int, bool]], share: float, counts: tuple[int, int]) -> Model:
    """texts: (text, label, for calibration); share: of toxic labels; counts: of clean and toxic labels."""
    model = Model(base=share)
    pool: dict[str, str] = {}
    split = {y: [[[pool.setdefault(w, w) for w in s] for s in sentences(t)] for t, label, later in texts if label == y and not later] for y in (0, 1)}
    count = {y: [Counter(w for s in t for w in s) for t in split[y]] for y in (0, 1)}
    cover = greedy_cover(count[1], count[0]) if count[0] and count[1] else []
    if not cover:
        return model
    # positive sentences: those with a piece that explains their text; the words at the piece are the examples
    explains = defaultdict(set)
    for p, dense, of in cover:
        for i in of:
            explains[i].add((p, dense))
    found = Counter()
    for i, t in enumerate(split[1]):
        own = explains[i]
        for s in t:
            found.update({(p, w) for w in s for x in _pieces(w) for p in ((x, False), (x, True)) if p in own})
    per = defaultdict(list)
    for (p, w), _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        per[p].append(w)
    insults = [w for p in per if not p[1] for w in per[p][:PIECE_WORDS]]
    thick = [w for p in per if p[1] for w in per[p][:PIECE_WORDS]]
    # insults with a character put in, so that gaps are tolerated
    whole = [p[1:-1] for p, dense, _ in cover if not dense and p.endswith("$") and len(p) >= 6]
    gapped = [w[:i] + c + w[i:] for w in whole for i in range(1, len(w)) for c in ".xe"] + ["-".join(w) for w in whole]
    each = max(1, MAX_LANDMARKS // len(cover))
    marks = _first_windows([w for p, dense, _ in cover for w in per[p, dense][:each]])
    for p, _, _ in cover:  # the bare beginning itself
        if not p.endswith("$"):
            stem = np.zeros((1, WINDOW), dtype=np.int64)
            c = char_codes(p[1:])[:-1][:WINDOW]
            stem[0, : len(c)] = c
            marks = np.concatenate([marks, stem])
    marks = np.unique(marks, axis=0)
    model.kernel = Kernel(marks)
    stems = tuple({p[1:] for p, dense, _ in cover if dense})
    negative = sorted({w for t in count[0] for w in t if not w.startswith(stems)} - set(insults) if stems else {w for t in count[0] for w in t} - set(insults))
    xn = _closest(model.kernel, windows(negative[:: max(1, len(negative) // CLEAN_WORDS)])[0], CLEAN_EXAMPLES)
    gram = model.kernel(marks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    empty = np.empty((0, len(marks)))
    strong = model.kernel(_first_windows(insults + gapped)) if insults else empty
    weak = model.kernel(_first_windows(thick)) if thick else empty
    a0, b0 = _svm_of(strong, np.concatenate([xn, weak]), root) if insults else (np.zeros(len(marks)), -1.0)
    a1, b1 = _svm_of(weak, xn, root) if thick else (np.zeros(len(marks)), -1.0)
    model.alpha, model.bias = np.c_[a0, a1], np.array([b0, b1])
    rest = [x for x in texts if x[2]] or texts
    x = model.features([words_of(t) for t, _, _ in rest])
    y = np.array([label for _, label, _ in rest], dtype=float)
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    model.link = _logistic(x, y, np.where(y == 1, counts[1] / n1, counts[0] / n0))
    model.forget()
    return model


def train(docs: DataFrame, labels: DataFrame, usable, at_most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> Model:
    """Learn from the labelled rows that ``usable`` (a condition on doc_id) admits, the first ones by hash.

    Of a doc_id that repeats, the least text counts.
    """
    ok = labels.where("doc_id is not null and toxic in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(ok.groupBy("toxic").count().collect())
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Model(base=share)
    ids = [r for y in (0, 1) for r in ok.where(F.col("toxic") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(at_most[y]).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.toxic), r.h, r.h % 3 == 0) for r in ids], "doc_id long, toxic int, h long, later boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = rows.groupBy("doc_id", "toxic", "h", "later").agg(F.min("text").alias("text")).select("h", "doc_id", "text", "toxic", "later")

    def fitted(batches):
        got, size = [], 0
        for b in batches:
            for text, toxic, later in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if size + len(text) <= SAMPLE_CHARS:  # a text that does not fit leaves room for others
                    size += len(text)
                    got.append((text, toxic, later))
        m = fit(got, share, (n0, n1))
        if m.kernel is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.kernel.landmarks, m.alpha, m.bias, m.link))], type=pa.binary())], names=["model"])

    made = rows.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(fitted, "model binary").collect()
    if not made:
        return Model(base=share)
    landmarks, alpha, bias, link = pickle.loads(made[0].model)
    return Model(share, Kernel(landmarks), alpha, bias, link)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns ``keep`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    read = [*names, *({"text"} - {*names})]
    at = read.index("text")

    def run(batches):
        m = held.value
        for b in slices(batches, "text"):
            s = m.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s)], names=[*names, "score"])

    return docs.select(*read).mapInArrow(run, schema)


def not_held_out():
    return crc_of_id() % 3 != 1


def op9_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, not_held_out())
    out = score(docs, model)
    held = F.coalesce(crc_of_id() % 3 == 1, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
