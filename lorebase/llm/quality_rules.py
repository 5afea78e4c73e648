"""Quality rules by repetition coverage.

For each text, rolling hashes over its word sequence find the n-grams of
several lengths that occur more than once in it; coverage is the share of the
text's word characters that lie inside such n-grams, or inside repeated lines.
The lengths are nested (a repeated 10-gram starts with a repeated 5-gram), so
longer lengths are only hashed where the shortest one repeats.

One pass, no shuffle: rows stay in the partition that read them.  Texts are
worked on in slices of a few megabytes, so memory does not depend on the
partition; one text is always whole.

Null or empty text: no words, ``base_failed`` (fewer than 10 words).  Repeated
rows each get their own result.  Further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, slices

#: n-gram length: largest share of characters inside repeated n-grams of it.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
#: Largest share of characters inside lines equal to an earlier line.
LINE_LIMIT = 0.20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup5_share double, dup6_share double, "
    "dup8_share double, dup10_share double"
)


def _oracle() -> str:
    """op10 in SQL: grams as their words, lines as their text."""
    gram = lambda n: ", ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, n))])
    cover = "".join(
        f""",
g{n} AS (SELECT doc_id, k, size, CASE WHEN k + {n - 1} <= n_words THEN md5(concat_ws(' ', {gram(n)})) END AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
t{n} AS (SELECT doc_id, k, size, (g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1)::INT AS twice FROM g{n}),
c{n} AS (SELECT doc_id, count(*) AS n, sum(size) AS chars FROM (SELECT doc_id, size, max(twice) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM t{n}) WHERE hit = 1 GROUP BY doc_id)"""
        for n in NGRAM_LIMITS
    )
    share = "".join(f", coalesce(c{n}.chars, 0)::DOUBLE / greatest(word_chars, 1) AS dup{n}_share" for n in NGRAM_LIMITS)
    joins = "".join(f" LEFT JOIN c{n} ON c{n}.doc_id = m.doc_id" for n in NGRAM_LIMITS)
    good = " AND ".join([f"dup_line_share <= {LINE_LIMIT}", *(f"dup{n}_share <= {x}" for n, x in NGRAM_LIMITS.items())])
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
u AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS x, unnest([length(y) FOR y IN w]) AS size, unnest(range(len(w))) + 1 AS k FROM d),
l AS (SELECT doc_id, line, count(*) - 1 AS more, coalesce(list_sum([length(x) FOR x IN regexp_extract_all(line, {word})]), 0) AS chars FROM (SELECT doc_id, unnest(string_split(t, E'\n')) AS line FROM d) WHERE regexp_matches(line, {word}) GROUP BY doc_id, line),
r AS (SELECT doc_id, sum(more) AS n, sum(more * chars) AS chars FROM l GROUP BY doc_id){cover},
f AS (SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_dup_lines, coalesce(c5.n, 0)::BIGINT AS n_repeat_words, coalesce(r.chars, 0)::DOUBLE / greatest(word_chars, 1) AS dup_line_share{share}
  FROM m LEFT JOIN r ON r.doc_id = m.doc_id{joins}),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {good} AS kept FROM b
"""


ORACLE = _oracle()


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` that starts at one of ``starts``."""
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_words(ids: np.ndarray, doc: np.ndarray, lengths) -> dict[int, np.ndarray]:
    """For each length, the words inside n-grams found twice or more in their own text.

    ids: a number for each word, equal for equal words; doc: its text's number,
    ascending.
    """
    total, out = len(ids), {}
    base = mix64(ids.astype(np.uint64) + np.uint64(1))
    per_doc = mix64(doc.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = None
    for n in sorted(lengths):
        at = np.arange(max(0, total - n + 1)) if live is None else live[live + n <= total]
        at = at[doc[at] == doc[at + n - 1]] if len(at) else at
        h = per_doc[at]
        for k in range(n):
            h = (h ^ base[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        live = np.sort(at[twice])
        out[n] = _covered(live, n, total)
    return out


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts and the coverage of each text."""
    texts = [t or "" for t in texts]
    number: dict[str, int] = {}
    ids, lens, n_words, dup_lines, dup_chars, symbols = [], [], [], [], [], []
    for t in texts:
        words = _WORD.findall(t)
        n_words.append(len(words))
        ids += [number.setdefault(w, len(number)) for w in words]
        lens += map(len, words)
        symbols.append(sum(map(t.count, _SYMBOLS)))
        seen, lines, chars = set(), 0, 0
        for line in t.split("\n"):
            if line in seen:
                lines += 1
                chars += sum(map(len, _WORD.findall(line)))
            elif line.strip(_SPACE):
                seen.add(line)
        dup_lines.append(lines)
        dup_chars.append(chars)
    n_words = np.array(n_words, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    lens = np.array(lens, dtype=np.int64)
    word_chars = np.bincount(doc, lens, len(texts)).astype(np.int64)
    cover = repeated_words(np.array(ids, dtype=np.int64), doc, NGRAM_LIMITS)
    of = np.maximum(word_chars, 1)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array(symbols, dtype=np.int64),
        "n_dup_lines": np.array(dup_lines, dtype=np.int64),
        "n_repeat_words": np.bincount(doc, cover[5], len(texts)).astype(np.int64),
        "dup_line_share": np.array(dup_chars) / of,
    }
    for n, c in cover.items():
        out[f"dup{n}_share"] = np.bincount(doc, lens * c, len(texts)) / of
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    good = out["dup_line_share"] <= LINE_LIMIT
    for n, limit in NGRAM_LIMITS.items():
        good &= out[f"dup{n}_share"] <= limit
    out["kept"] = ~out["base_failed"] & good
    return out


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the shares and the verdict of each row of ``docs``."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in slices(batches, "text"):
            m = measure(b.column(1).to_pylist()) | {"doc_id": b.column(0)}
            yield pa.RecordBatch.from_arrays([m[n] if n == "doc_id" else pa.array(m[n]) for n in names], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
