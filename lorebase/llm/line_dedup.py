"""Removing boilerplate lines by the number of distinct sites that carry them.

A HyperLogLog sketch of the sites is kept for each line's hash; sketches merge
in the aggregation, map-side first, so a line found in a third of all
documents costs one sketch per task.  Sketches decide lines that are clearly
below or above the threshold; lines near it get an exact distinct count.

DataFrame functions only.  A line that at least ``min_sites`` sites carry is
boilerplate and leaves every document, with two exceptions, which are left
whole for document-level dedup: documents of which nothing would be left, and
copies of a page: documents that would lose more than ``max_share`` of their
characters and at least ``copy_chars``, more than boilerplate comes to.

Lines are what ``\\n`` separates, compared without surrounding white space;
blank lines are neither counted nor removed.  A null source is no site.  Null
text stays null, with 0 lines.  Rows with equal doc_id and text get equal
results; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_SITES = 8
MAX_SHARE, COPY_CHARS = 0.5, 600
#: Sketches have 2**LG_K registers; standard error about 0.8 / sqrt(2**LG_K).
LG_K = 10
#: Estimates within this share of the threshold are counted exactly (over 6 standard errors).
NEAR = 0.2


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def exploded_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, pos, len, h1, h2 of every line that is not blank."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", _bare(F.col("line"))).where("line <> ''")
    return rows.select("doc_id", "text_hash", F.col("source").alias("site"), "pos", F.length("line").alias("len"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines that at least ``min_sites`` distinct sites carry."""
    near = F.col("estimate").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))
    seen = lines.where("site is not null").groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    seen = Scratch(lines.sparkSession).save(seen.where(F.col("estimate") >= min_sites * (1 - NEAR)).withColumn("near", near))
    clear = seen.where("not near").select("h1", "h2")
    unsure = seen.where("near").select(F.col("h1").alias("a"), F.col("h2").alias("b"))
    exact = lines.where("site is not null").join(unsure, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), "left_semi")
    exact = exact.select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return clear.unionByName(exact.select("h1", "h2"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, copy_chars: int = COPY_CHARS) -> DataFrame:
    """``docs`` with n_lines, n_spread, n_removed and kept_text added; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_spread", "n_removed", "kept_text")
    lines = exploded_lines(docs)
    spread = Scratch(docs.sparkSession).save(spread_lines(lines, min_sites))
    spread = spread.select(F.col("h1").alias("a"), F.col("h2").alias("b"))
    hit = lines.join(spread, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    # rows that repeat doc_id and text give each position again
    hit = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("_hits"))
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_hits")
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    rows = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").drop("_id", "_hash", "_text_hash")
    rows = rows.withColumn("_lines", F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>")))
    lens = F.filter(F.transform("_lines", lambda x: F.length(_bare(x))), lambda n: n > 0)
    rows = rows.withColumn("_lens", lens).withColumn("n_lines", F.size("_lens").cast("long"))
    chars = F.aggregate("_lens", F.lit(0).cast("long"), lambda s, n: s + n)
    lost = F.aggregate(F.transform("_hits", lambda x: x["len"]), F.lit(0).cast("long"), lambda s, n: s + n)
    rows = rows.withColumn("n_spread", F.coalesce(F.size("_hits"), F.lit(0)).cast("long"))
    copy = (lost > F.lit(max_share) * chars) & (lost >= copy_chars)
    cut = F.col("_hits").isNotNull() & (F.size("_hits") < F.size("_lens")) & ~copy
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.transform("_hits", lambda x: x["pos"]))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    rows = rows.withColumn("_cut", cut)
    rows = rows.withColumn("n_removed", F.when(F.col("_cut"), F.col("n_spread")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("kept_text", F.when(F.col("_cut"), kept).otherwise(F.col("text")))
    return rows.drop("_hits", "_lines", "_lens", "_cut")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, pos, trim(line, E' \\t\\n\\v\\f\\r') AS line FROM (
    SELECT doc_id, source, unnest(string_split(text, E'\\n')) AS line, unnest(range(len(string_split(text, E'\\n')))) AS pos FROM documents)
  WHERE trim(line, E' \\t\\n\\v\\f\\r') <> ''),
s AS (SELECT line FROM l WHERE source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
t AS (SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS chars, count(*) FILTER (line IN (SELECT line FROM s)) AS n_spread,
      coalesce(sum(length(line)) FILTER (line IN (SELECT line FROM s)), 0) AS lost,
      list(pos) FILTER (line IN (SELECT line FROM s)) AS hits FROM l GROUP BY doc_id),
r AS (SELECT d.doc_id, d.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread, 0) AS n_spread,
      coalesce(n_spread > 0 AND n_spread < n_lines AND NOT (lost > {MAX_SHARE} * chars AND lost >= {COPY_CHARS}), false) AS cut, hits, string_split(d.text, E'\\n') AS a
      FROM documents d LEFT JOIN t USING (doc_id)),
k AS (SELECT *, CASE WHEN cut THEN array_to_string([a[i + 1] FOR i IN range(len(a)) IF NOT list_contains(hits, i)], E'\\n') ELSE text END AS kept FROM r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_spread::BIGINT AS n_spread, (CASE WHEN cut THEN n_spread ELSE 0 END)::BIGINT AS n_removed,
       length(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256 FROM k
"""


def op8_report(docs: DataFrame) -> DataFrame:
    r = remove_spread_lines(docs)
    return r.select("doc_id", "n_lines", "n_spread", "n_removed", F.length("kept_text").cast("long").alias("n_chars_kept"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
