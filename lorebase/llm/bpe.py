"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

A word's encoding depends on its end only so far.  Compare what the merges make
of two words with a common beginning w.  At first both agree on all of w, up to
its end.  They come to differ further to the left only when a merge (u, v)
crosses the place up to which they agree, in one of them alone, and that place
moves left by u.  The next merge to do so has a later rank, and its right
operand begins, in its own derivation, with u.  So the places that the
difference can reach are chains of merges with rising ranks, and the longest
chain, weighted by the bytes of u, is a lookahead that suffices for this merge
list: tokens that end at least so far before the end of what has been read are
final, whatever follows (``lookahead``; 667 bytes for the model at hand).  What
follows a final token is encoded as if it stood alone, since no merge has ever
crossed that place.  So words of any length are encoded with a buffer of
constant size, and texts in pieces.

A text goes through these steps, as the model file has them: its special tokens
are cut out; NFC; lower case, character by character; words by a pattern, white
space dropped; bytes as characters; merges, the last byte marked as a word's
end.  Pieces of a text are cut at white space; stretches without any pass
through a segmenter that keeps the open word.  A run of combining marks is the
one thing that is held whole, since NFC orders it.

Decoding goes token by token: as the model's library does it (it has no decoder,
so tokens are joined by spaces), or back to text, through the bytes.

Null text has null ids (op12: is empty); empty text has none.  Repeated rows each
get their result; other columns pass through, and one named like the result is
replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, slices

MODEL = "/opt/tokenizers/word_bpe_49k.json"
END = "</w>"
#: Characters of a text that are cut into words at once; of a stretch without white space that are normalised at once.
PIECE, STRETCH = 1 << 20, 1 << 16
#: From so many bytes on a word is streamed; a streamed word is encoded by blocks of this size.
LONG, BLOCK = 1 << 13, 1 << 13
#: Words kept with their ids, of so many characters at most: together about 40 MB.
CACHE_WORDS, CACHE_CHARS = 150_000, 40
_NONE = 1 << 30

#: The pattern of words of the model file, with classes of letters, digits and others.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|{O}+"
_ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"


#: Classes of letters, digits and others.
_CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "O": r"[^\p{White_Space}\p{L}\p{N}]"}


def newer_characters() -> tuple[str, dict[int, str]]:
    """(characters that are letters or digits for the pattern library only, lower case of letters that Python does not know).

    The Unicode tables of Python, of the pattern library and of the tokenizer
    library are of different years.  The few thousand characters that the first
    does not know are asked of the last.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    known = regex.compile(r"[\p{L}\p{N}]")
    newer = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    shared = {c for c, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(newer))}
    lower = {ord(c): x for c in newer if (x := normalizers.Lowercase().normalize_str(c)) != c}
    return "".join(c for c in newer if c not in shared), lower


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


def lookahead(rules: list[tuple[str, str]], mark: str = END) -> int:
    """Bytes before the end of what is read from which on tokens may still change.

    The rules, by rank, must be proper: operands are characters or made by
    earlier rules, and no two rules make the same token.
    """
    made: dict[str, tuple[str, str]] = {}
    targets = {a + b for a, b in rules}
    reach: dict[str, int] = {}  # of chains whose last left operand this is
    most = 0
    for a, b in rules:
        if any(x in targets and x not in made for x in (a, b)) or a + b in made:
            raise ValueError(f"the merge list is not proper at {a} {b}")
        spine, before = b, reach.get(b, 0)
        while spine in made:
            spine = made[spine][0]
            before = max(before, reach.get(spine, 0))
        far = len(a.replace(mark, "")) + before
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
        made[a + b] = (a, b)
    return most + 1  # the last byte may turn out to be the word's last


class Model:
    """A merge list with its vocabulary."""

    def __init__(self, vocab: dict[str, int], rules: list[tuple[str, str]], specials: dict[str, int]):
        self.tokens = [""] * (1 + max([*vocab.values(), *specials.values()]))
        for t, i in [*vocab.items(), *specials.items()]:
            self.tokens[i] = t
        chars = byte_characters()
        self.plain = [vocab[c] for c in chars]
        self.last = [vocab[c + END] for c in chars]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(rules)}
        self.made = [vocab[a + b] for a, b in rules]
        self.specials = specials
        self.length = [0 if t in specials else len(t.removesuffix(END)) for t in self.tokens]
        self.look = lookahead(rules)
        self.newer, self.lower = newer_characters()
        self._cache: dict[str, bytes] = {}
        self._compiled: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}, "_compiled": {}}

    def table(self, name: str):
        """Patterns and tables of tokens are made where they are used."""
        if not self._compiled:
            special = "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)"
            self._compiled = {"ascii": re.compile(_ASCII_WORDS), "special": re.compile(special), "newer": frozenset(self.newer)}
            less = "[" + "".join(f"\\U{ord(c):08x}" for c in self.newer) + "]"
            exact = {"L": f"[{_CLASSES['L']}--{less}]", "N": f"[{_CLASSES['N']}--{less}]", "O": f"[{_CLASSES['O']}||{less}]"}
            for mode, of in (("", _CLASSES), ("!", exact if self.newer else _CLASSES)):
                self._compiled |= {k + mode: regex.compile(c + "+", regex.V1) for k, c in of.items()}
                self._compiled["words" + mode] = regex.compile(re.sub(r"\{([LNO])\}", lambda k, of=of: of[k[1]], _WORDS), regex.V1)
            byte = {c: b for b, c in enumerate(byte_characters())}
            bare = lambda t: bytes(map(byte.__getitem__, t.removesuffix(END))) + (b" " if t.endswith(END) else b"")
            self._compiled |= {"tokens": np.array(self.tokens, dtype=object), "bytes": [t.encode() if t in self.specials else bare(t) for t in self.tokens]}
        return self._compiled[name]

    def words(self, text: str) -> list[str]:
        """The words of a text that is not cut inside a word."""
        text = normalized(text, self.lower)
        return self.table("ascii" if text.isascii() else "words" + self.mode(text)).findall(text)

    def mode(self, text: str) -> str:
        """The patterns that suit a text: those that know the newer characters are slow."""
        return "" if text.isascii() or self.table("newer").isdisjoint(text) else "!"

    def merged(self, ids: list[int]) -> list[int]:
        """The symbols after all merges; the list is used up."""
        if len(ids) > 64:
            return self._merged_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)  # the leftmost of the first
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for many symbols."""
        n, sym = len(ids), list(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, made = self.rank, self.made
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(sym[i] << 20 | sym[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if sym[i] >= 0 else -1
            if j < 0 or rank.get(sym[i] << 20 | sym[j]) != r:
                continue
            sym[i], sym[j] = made[r], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (x := rank.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (x, i))
            h = left[i]
            if h >= 0 and (x := rank.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [s for s in sym if s >= 0]

    def encode_bytes(self, word: bytes) -> list[int]:
        """The ids of a whole word."""
        if len(word) > LONG:
            stream = WordStream(self)
            return [*stream.feed(word), *stream.finish()]
        return self.merged([*map(self.plain.__getitem__, word[:-1]), self.last[word[-1]]])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes of int32, of distinct words or special tokens."""
        cache, out = self._cache, []
        for w in words:
            b = cache.get(w)
            if b is None:
                ids = [self.specials[w]] if w in self.specials else self.encode_bytes(w.encode("utf-8", "surrogatepass"))
                b = np.array(ids, dtype=np.int32).tobytes()
                if len(w) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = b
            out.append(b)
        return out


def read_model(path: str = MODEL) -> Model:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in raw["model"]["merges"]]
    specials = {t["content"]: t["id"] for t in raw["added_tokens"]}
    return Model({t: i for t, i in raw["model"]["vocab"].items() if t not in specials}, rules, specials)


class WordStream:
    """One word, byte by byte: tokens leave once they are stable."""

    def __init__(self, m: Model):
        self.m, self.held = m, b""

    def feed(self, data: bytes) -> list[int]:
        out, m = [], self.m
        for a in range(0, len(data), BLOCK):
            self.held += data[a : a + BLOCK]
            if len(self.held) < m.look + BLOCK:
                continue
            at, stable = 0, len(self.held) - m.look
            for i in m.merged([m.plain[b] for b in self.held]):
                if at + m.length[i] > stable:
                    break
                out.append(i)
                at += m.length[i]
            self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        held, self.held, m = self.held, b"", self.m
        return m.merged([*(m.plain[b] for b in held[:-1]), m.last[held[-1]]]) if held else []


class Segmenter:
    """Words of normalised text that comes in pieces cut anywhere; the word at a piece's end stays open."""

    def __init__(self, m: Model):
        self.m, self.held = m, ""
        self.kind: str | None = None  # of a run whose beginning is in ``word``
        self.word: WordStream | None = None

    def feed(self, text: str, last: bool = False) -> list[int]:
        out, self.held = [], self.held + text
        mode = self.m.mode(self.held)
        while True:
            if self.kind:
                run = self.m.table(self.kind + mode).match(self.held)
                n = run.end() if run else 0
                out += self.word.feed(self.held[:n].encode("utf-8", "surrogatepass"))
                self.held = self.held[n:]
                if not self.held and not last:
                    return out
                out += self.word.finish()
                self.kind = None
            rest = ""
            for w in self.m.table("words" + mode).finditer(self.held):
                if not last and w.end() > len(self.held) - 3:  # may go on, or be a contraction
                    rest = self.held[w.start() :]
                    break
                out += self.m.encode_bytes(w.group().encode("utf-8", "surrogatepass"))
            self.held = rest
            if len(rest) <= LONG:
                return out
            self.kind = "L" if self.m.table("L" + mode).match(rest) else "O"
            self.word = WordStream(self.m)


def normalized(text: str, lower: dict[int, str] | None = None) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # character by character: no final sigma
        if lower and max(text) > "\u1c88":  # all characters of the table are above
            text = text.translate(lower)
    return text.lower()


_second: set[str] = set()


def _joins_left(c: str) -> bool:
    """Whether NFC may change what stands before ``c``."""
    if not _second:
        pairs = (unicodedata.decomposition(chr(i)).split() for i in range(0x20000))
        _second.update(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<"))
        _second.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return unicodedata.combining(c) != 0 or c in _second


def normalized_pieces(text: str, lower: dict[int, str], size: int = STRETCH):
    """``normalized(text, lower)`` in pieces, cut where NFC does not reach across."""
    a = 0
    while a < len(text):
        b = min(a + size, len(text))
        while b < len(text) and _joins_left(text[b]):
            b += 1
        yield normalized(text[a:b], lower)
        a = b


def pieces(text: str, m: Model, size: int = PIECE):
    """("special", token), ("whole", text cut at white space) and ("stretch", text without ASCII spaces) in order."""

    def between(a: int, b: int):
        while b - a > size:
            cut = max(text.rfind(c, a + 1, a + size) for c in " \n\t")
            if cut > 0:
                yield "whole", text[a:cut]
                a = cut
            else:
                ends = [k for c in " \n\t" if (k := text.find(c, a + size, b)) >= 0]
                end = min(ends, default=b)
                yield "stretch", text[a:end]
                a = end
        if b > a:
            yield "whole", text[a:b]

    at = 0
    for s in m.table("special").finditer(text):
        yield from between(at, s.start())
        yield "special", s.group()
        at = s.end()
    yield from between(at, len(text))


def transduced(texts: list[str | None], m: Model):
    """(number of the text, ids) of all texts, in order, in pieces of bounded size."""
    held, size = [], 0

    def flush():
        every = [w for _, ws in held for w in ws]
        if not every:
            return
        codes, distinct = pd.factorize(np.array(every, dtype=object))
        coded = m.encode_words(distinct.tolist())
        flat = np.frombuffer(b"".join(coded), dtype=np.int32)
        sizes = np.array([len(b) // 4 for b in coded])
        starts, n = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        upto = np.cumsum(n)
        ids = flat[np.repeat(starts - upto + n, n) + np.arange(upto[-1])]
        ends = np.append(0, upto)[np.cumsum([0, *(len(ws) for _, ws in held)])]
        for (k, _), a, b in zip(held, ends, ends[1:]):
            yield k, ids[a:b]

    for k, text in enumerate(texts):
        for kind, part in pieces(text or "", m):
            if kind == "stretch":
                yield from flush()
                held, size = [], 0
                seg = Segmenter(m)
                for piece in normalized_pieces(part, m.lower):
                    yield k, np.array(seg.feed(piece), dtype=np.int32)
                yield k, np.array(seg.feed("", True), dtype=np.int32)
                continue
            held.append((k, [part] if kind == "special" else m.words(part)))
            size += len(part)
            if size >= CHUNK_BYTES:
                yield from flush()
                held, size = [], 0
    yield from flush()


class Decoder:
    """Ids to text, piece by piece.  ``library``: tokens joined by spaces; else through the bytes, a space after each word."""

    def __init__(self, m: Model, library: bool = True):
        self.library, self.first = library, True
        self.tokens = m.table("tokens")
        if not library:
            self.bytes = m.table("bytes")
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        if not self.library:
            return self.utf8.decode(b"".join(self.bytes[i] for i in ids))
        out = " ".join(self.tokens[np.asarray(ids)].tolist())
        out, self.first = (out if self.first else " " + out), False
        return out

    def finish(self) -> str:
        return "" if self.library else self.utf8.decode(b"", True)


def encode_texts(texts: list[str | None], m: Model) -> list[np.ndarray | None]:
    parts: list[list] = [[] for _ in texts]
    for k, ids in transduced(texts, m):
        parts[k].append(ids)
    none = np.zeros(0, dtype=np.int32)
    return [None if t is None else np.concatenate([none, *p]) for t, p in zip(texts, parts)]


def decode_ids(ids, m: Model, library: bool = True) -> str:
    d = Decoder(m, library)
    return d.feed(ids) + d.finish()


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def encode(docs: DataFrame, m: Model, column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the array of ids of ``column``."""
    docs = docs.drop(into)
    held, at = docs.sparkSession.sparkContext.broadcast(m), docs.columns.index(column)

    def run(batches):
        for b in slices(batches, column):
            ids = encode_texts(b.column(at).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*b.schema.names, into])

    return docs.mapInArrow(run, f"{_schema(docs)}, `{into}` array<int>")


def decode(rows: DataFrame, m: Model, column: str = "ids", into: str = "text", library: bool = True) -> DataFrame:
    """``rows`` with the text of the ids in ``column``."""
    rows = rows.drop(into)
    held, at = rows.sparkSession.sparkContext.broadcast(m), rows.columns.index(column)

    def run(batches):
        for b in batches:
            text = [None if i is None else decode_ids(i, held.value, library) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, type=pa.string())], names=[*b.schema.names, into])

    return rows.mapInArrow(run, f"{_schema(rows)}, `{into}` string")


def op12_report(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 (of the ids decoded again) of every row.

    Ids are hashed and decoded as they leave the transducer.
    """
    held = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        m = held.value
        decimal = np.array([str(i) for i in range(len(m.tokens))], dtype=object)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            n, sha, back = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            now, decoder = -1, None
            for k, ids in transduced(texts, m):
                if k != now:
                    now, decoder = k, Decoder(m)
                if len(ids):
                    sha[k].update(((" " if n[k] else "") + " ".join(decimal[ids].tolist())).encode())
                    back[k].update(decoder.feed(ids).encode())
                    n[k] += len(ids)
            columns = [b.column(0), pa.array(n, type=pa.int64()), pa.array([x.hexdigest() for x in sha]), pa.array([x.hexdigest() for x in back])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
