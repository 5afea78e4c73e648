"""URL filter: rules first, then the ratio of two character models.

Rules name a host (with its subdomains) and a beginning of the path; the
longest that fits decides.  Urls that no rule fits are judged by two
variable-order Markov models over characters, one of the urls that rules
allow and one of those they block.  A model blends orders 0 to ORDER: each
order's estimate is drawn towards the next lower one by PRIOR pseudo-counts,
so a context that was never seen gives way to a shorter one.  The score is the
difference of the log-likelihoods per character; the cut-off is the one that
separates the ruled urls best (balanced).

Counts cover all ruled urls and are exact.  A character and the ORDER before it
are one number (9 bits a symbol, no hashing), and the table of these grams
grows with the input.  What a character adds to the score depends on its gram
alone, so it is worked out once per distinct gram, by joins with the sums of
the shorter ones; the grams of distinct urls are then joined to it.

Null or malformed urls have empty host and path, fit no rule, and are judged
like other texts (null as the empty one, score 0).  Ties go to allow.  Without
both allowed and blocked urls to learn from, urls that no rule fits are
allowed.  Repeated rows each get a result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: (host, beginning of the path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER, PRIOR = 5, 4.0
VERDICTS = ("allow", "block")
#: Symbols: bytes, and one mark in front of the url; so many bits hold one.
_ALPHABET, _BITS = 257, 9
#: Scores are added up as whole numbers of this part, so that no order of adding matters.
#: A url has fewer than 2 ** 31 characters and a logarithm is below 40, so no sum reaches 2 ** 63.
_PART = 1e-8
#: Urls go through numpy in pieces of about so many bytes.
PIECE = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and the rule's verdict."""
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule = verdict = None
    for host, path, said in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return rows.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if verdict is None else verdict)


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each character (lowest bits) with the ORDER before it (nearest first), and each one's url."""
    lens = np.array([len(u) for u in urls], dtype=np.int64)
    of = np.repeat(np.arange(len(urls)), lens)
    chars = np.frombuffer(b"".join(urls), dtype=np.uint8).astype(np.int64) + 1
    first = np.repeat(np.cumsum(lens) - lens, lens)
    at = np.arange(len(chars))
    out = chars.copy()
    for k in range(1, ORDER + 1):
        out |= np.where(at - k >= first, chars[np.maximum(at - k, 0)], 0) << (_BITS * k)
    return out, of


def _pieces(urls: list[bytes], size: int | None = None):
    """The grams of ``urls`` and the number of each one's url, in pieces; a long url is cut, with the ORDER characters before each cut."""
    size = size or PIECE
    parts = ((i, u[max(a - ORDER, 0) : a + size], min(a, ORDER)) for i, u in enumerate(urls) for a in range(0, len(u), size))

    def grams(held):
        gram, of = _grams([part for _, part, _ in held])
        own, skip = (np.array([x[k] for x in held], dtype=np.int64) for k in (0, 2))
        starts = np.cumsum([0, *(len(part) for _, part, _ in held[:-1])])
        new = np.arange(len(gram)) - starts[of] >= skip[of]
        return gram[new], own[of[new]]

    held, total = [], 0
    for part in parts:
        held.append(part)
        total += len(part[1])
        if total >= size:
            yield grams(held)
            held, total = [], 0
    if held:
        yield grams(held)


def _urls(column: pa.Array) -> list[bytes]:
    return [(u or "").lower().encode() for u in column.to_pylist()]


def count_grams(urls: DataFrame) -> DataFrame:
    """gram, a, b: every gram of ``urls`` (url, n_allow, n_block), and how often allowed and blocked ones have it."""

    def run(batches):
        for batch in slices(batches, "url"):
            if not batch.num_rows:
                continue
            for gram, of in _pieces(_urls(batch.column(0))):
                seen, place = np.unique(gram, return_inverse=True)
                n = [np.zeros(len(seen), dtype=np.int64) for _ in VERDICTS]
                for i, sums in enumerate(n):
                    np.add.at(sums, place, batch.column(1 + i).to_numpy()[of])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, *n)], names=["gram", "a", "b"])

    part = urls.select("url", "n_allow", "n_block").mapInArrow(run, "gram long, a long, b long")
    return part.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def gram_values(grams: DataFrame) -> DataFrame:
    """gram and what it adds to log P(url | allowed) - log P(url | blocked), in _PARTs.

    d: by all counts; d_allow, d_block: for a url counted under that verdict, its own count left out.
    """
    rows = grams
    for k in range(ORDER + 1):
        of_gram = F.col("gram").bitwiseAND(F.lit((1 << (_BITS * (k + 1))) - 1))
        for kind, key, symbols in (("n", of_gram, k + 1), ("c", F.shiftright(of_gram, _BITS), k)):
            name = f"{kind}{k}"
            if kind == "n" and k == ORDER:
                rows = rows.withColumn(f"{name}a", F.col("a")).withColumn(f"{name}b", F.col("b"))
                continue
            sums = grams.groupBy(key.alias(name)).agg(F.sum("a").alias(f"{name}a"), F.sum("b").alias(f"{name}b"))
            if symbols <= 2:  # at most 257**2 rows, whatever the input
                sums = F.broadcast(sums)
            rows = rows.withColumn(name, key).join(sums, name).drop(name)

    def log_p(side: str, own: int) -> Column:
        p = F.lit(1 / _ALPHABET)
        for k in range(ORDER + 1):
            n, c = (F.greatest(F.col(f"{kind}{k}{side}") - own, F.lit(0)) for kind in "nc")
            p = (n + PRIOR * p) / (c + PRIOR)
        return F.log(p)

    rows = rows.select("gram", *(log_p(side, own).alias(f"{side}{own}") for side in "ab" for own in (0, 1)))
    held = {"d": ("a0", "b0"), "d_allow": ("a1", "b0"), "d_block": ("a0", "b1")}
    return rows.select("gram", *(F.round((F.col(x) - F.col(y)) / _PART).cast("long").alias(name) for name, (x, y) in held.items()))


def grams_of(urls: DataFrame) -> DataFrame:
    """uid, gram, n, size of each gram of ``urls`` (uid, url); size: characters of the url. A long url's gram may have several rows."""

    def run(batches):
        for batch in slices(batches, "url"):
            if not batch.num_rows:
                continue
            texts = _urls(batch.column(1))
            size = np.array([len(t) for t in texts], dtype=np.int64)
            uid = batch.column(0).to_numpy()
            for gram, of in _pieces(texts):
                order = np.lexsort((gram, of))
                gram, of = gram[order], of[order]
                new = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])][: len(gram)])
                n = np.diff(np.r_[new, len(gram)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[of[new]], gram[new], n.astype(np.int64), size[of[new]])], names=["uid", "gram", "n", "size"])

    return urls.select("uid", "url").mapInArrow(run, "uid long, gram long, n long, size long")


def url_scores(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, score and own (the score without the url's own count) of ``urls`` (uid, url, n_allow, n_block) that are not empty."""
    values = scratch.save(gram_values(scratch.save(count_grams(urls))))
    sums = grams_of(urls).join(values, "gram").groupBy("uid").agg(F.max("size").alias("size"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("d", "d_allow", "d_block")))
    return sums.select("uid", *((F.col(c) * _PART / F.col("size")).alias(name) for c, name in (("d", "score"), ("d_allow", "own_allow"), ("d_block", "own_block"))))


def cut_off(ruled: DataFrame, step: float = 0.01) -> float:
    """The score that separates allowed from blocked urls (score, said, n) with the fewest errors, both kinds weighing the same."""
    cell = F.greatest(F.least(F.floor(F.col("score") / step), F.lit(2000)), F.lit(-2000)).cast("int")
    rows = ruled.groupBy(cell.alias("cell"), "said").agg(F.sum("n").alias("count")).collect()  # at most 2 * 4001
    total = {v: sum(r["count"] for r in rows if r.said == v) for v in VERDICTS}
    best, at, wrong, last = None, 0.0, 1.0, None  # cutting below everything: all blocked ones pass
    for c in sorted({r.cell for r in rows}):
        if best is None or wrong < best - 1e-12:  # the middle of the gap below
            best, at = wrong, step * (c if last is None else (last + 1 + c) / 2)
        for r in rows:
            if r.cell == c:
                wrong += r["count"] / max(1, total[r.said]) * (1 if r.said == "allow" else -1)
        last = c
    return at


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    scratch = Scratch(pages.sparkSession)
    rows = with_rules(pages.selectExpr("cast(page_id as long) page_id", "url"), rules)
    is_said = [F.sum((F.col("ruled") == v).cast("long")) for v in VERDICTS]
    urls = rows.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(*(F.coalesce(n, F.lit(0)).alias(f"n_{v}") for v, n in zip(VERDICTS, is_said)))
    urls = scratch.save(urls.withColumn("uid", F.monotonically_increasing_id()))
    counts = urls.where("url <> ''").agg(*(F.coalesce(F.sum(f"n_{v}"), F.lit(0)) for v in VERDICTS)).first()
    if not all(counts):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored = urls.join(url_scores(urls, scratch), "uid", "left").na.fill(0.0, ["score", "own_allow", "own_block"])
    scored = scratch.save(scored.drop("uid"))
    ruled = reduce(DataFrame.unionByName, (scored.where(f"n_{v} > 0").select(F.col(f"own_{v}").alias("score"), F.lit(v).alias("said"), F.col(f"n_{v}").alias("n")) for v in VERDICTS))
    at = cut_off(ruled)
    out = rows.join(scored.select(F.col("url").alias("_url"), "score"), F.coalesce("url", F.lit("")) == F.col("_url"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
