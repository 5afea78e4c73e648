"""Two-stage search: lexical candidates, then a score that blends semantics, text, strength and recency.

The filters on tags and on current memories stand above the first limit, as
the semantics ask: archived memories use up candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import current_strength, day_of, is_current, recency_score, strength_score
from ..functions.text import jaccard, normalize, share_contained, trigrams, words
from ..functions.vector import normalized_cosine
from ..plans.scratch import written

@dataclass(frozen=True)
class Probe:
    """A normalised query with what the scores need of it: literals, or columns of a table of queries."""

    q: Column
    grams: Column
    #: Words of three, and distinct words of two characters and more.
    long_words: Column
    words: Column

    @staticmethod
    def columns(q: Column) -> dict[str, Column]:
        return {"_q": q, "_grams": trigrams(q), "_long": words(q, 3), "_words": F.array_distinct(words(q, 2))}

    @classmethod
    def of_columns(cls) -> Probe:
        return cls(*(F.col(c) for c in ("_q", "_grams", "_long", "_words")))

    @classmethod
    def literal(cls, spark: SparkSession, query: str) -> Probe:
        """Computed once, so that a scan has constants only."""
        row = spark.range(1).select(*[c.alias(n) for n, c in cls.columns(normalize(F.lit(query))).items()]).first()
        many = lambda x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
        return cls(F.lit(row._q), many(row._grams), many(row._long), many(row._words))


def _low(tags: Column) -> Column:
    return F.transform(tags, F.lower)


def candidate_by_tag(p: Probe) -> Column:
    """A tag and the query contain one another, or a tag and a word do."""
    return F.exists(_low(F.col("tags")), lambda t: F.contains(p.q, t) | F.contains(t, p.q) | F.exists(p.long_words, lambda w: F.contains(t, w) | F.contains(w, t)))


def lexical_scores(df: DataFrame, p: Probe, now: Column) -> DataFrame:
    """Adds _fuzzy, _overlap, _exact, _tag and _text_score; the score is null where nothing is relevant.

    (A filter on these would be pushed below them, and compute them again.)
    """
    df = df.withColumn("_fuzzy", jaccard(p.grams, F.col("trigrams")))
    df = df.withColumn("_overlap", share_contained(p.long_words, F.col("content_normalized")))
    df = df.withColumn("_exact", F.when(F.contains(F.col("content_normalized"), p.q), 0.5).otherwise(0.0))
    hit = F.exists(_low(F.col("tags")), lambda t: F.exists(p.long_words, lambda w: F.contains(t, w)))
    df = df.withColumn("_tag", F.when(hit, 0.3).otherwise(0.0))
    score = F.col("_exact") + 0.5 * F.col("_fuzzy") + 0.3 * F.col("_overlap") + F.col("_tag") + 0.2 * current_strength(now)
    return df.withColumn("_text_score", F.when(relevant(), score))


def relevant() -> Column:
    return (F.col("_fuzzy") > 0.05) | (F.col("_overlap") > 0) | (F.col("_exact") > 0) | (F.col("_tag") > 0)


def best_by_text(scored: DataFrame, limit: int) -> DataFrame:
    """The relevant rows among the first ``limit``."""
    return scored.orderBy(F.desc_nulls_last("_text_score"), "id").limit(limit).where("_text_score is not null")


def candidates(df: DataFrame, p: Probe, length: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The memories that stage one may return, for a query of so many characters; for three and more, its own filter decides alone."""
    by_tag = candidate_by_tag(p)
    inside = F.contains(F.col("content_normalized"), p.q)
    if cfg.candidate_mode == "substring_or_tag":
        return df.where(inside | by_tag)
    if length >= 3:
        return df
    shared = F.arrays_overlap(F.col("trigrams"), p.grams)
    any_shared = df.agg(F.coalesce(F.max(shared), F.lit(False)).alias("_any"))  # one row
    return df.crossJoin(F.broadcast(any_shared)).where(shared | (~F.col("_any") & inside) | by_tag).drop("_any")


def text_search(df: DataFrame, query: str | None, limit: int, now: Column, cfg: EngineConfig = DEFAULT, probe: Probe | None = None) -> DataFrame:
    """The best ``limit`` memories by text; blank queries find nothing."""
    blank = query is None or not query.strip()
    p = probe or Probe.literal(df.sparkSession, "" if blank else query)
    if blank:
        return lexical_scores(df.limit(0), p, now)
    return best_by_text(lexical_scores(candidates(df, p, len(query.strip()), cfg), p, now), limit)


def fuzzy_score(p: Probe) -> Column:
    """The strongest of: whole match, title match, first matching tag, words in title or text, trigrams."""
    title, text = F.lower(F.col("title")), F.col("content_normalized")
    tag = F.transform(
        _low(F.col("tags")),
        lambda t: F.when(F.contains(p.q, t) | F.contains(t, p.q), 0.9).when(F.exists(p.words, lambda w: F.contains(t, w) | F.contains(w, t)), 0.8).otherwise(0.0),
    )
    first_tag = F.coalesce(F.get(F.filter(tag, lambda s: s > 0), F.lit(0)), F.lit(0.0))
    j = jaccard(p.grams, F.col("trigrams"))
    return F.greatest(
        F.when(F.contains(text, p.q), 1.0).otherwise(0.0),
        F.when(F.contains(title, p.q), 0.95).otherwise(0.0),
        first_tag,
        0.7 * share_contained(p.words, title),
        0.5 * share_contained(p.words, text),
        F.when(j > 0.05, 0.6 * j).otherwise(0.0),
    )


def final_scores(df: DataFrame, p: Probe, now: Column, vector: Column | None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds fuzzy_score, strength_score, recency_score, semantic_score and score."""
    df = df.withColumn("fuzzy_score", fuzzy_score(p))
    df = df.withColumn("strength_score", strength_score(current_strength(now)))
    df = df.withColumn("recency_score", recency_score(now, F.col("last_accessed_at"), cfg.recency_days))
    lw, sw = cfg.lexical_weights, cfg.semantic_weights
    lexical = lw[0] * F.col("fuzzy_score") + lw[1] * F.col("strength_score") + lw[2] * F.col("recency_score")
    if vector is None:
        return df.withColumn("semantic_score", F.lit(0.0)).withColumn("score", lexical)
    known = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    df = df.withColumn("semantic_score", F.when(vector.isNotNull() & known, normalized_cosine(vector, F.col("embedding"))).otherwise(0.0))
    blend = sw[0] * F.col("semantic_score") + sw[1] * F.col("fuzzy_score") + sw[2] * F.col("strength_score") + sw[3] * F.col("recency_score")
    return df.withColumn("score", F.when(vector.isNull(), lexical).otherwise(blend))


def has_tag(tags: list[str]) -> Column:
    """One of the memory's tags is one of these, whatever the case."""
    wanted = F.array(*[F.lit(t.lower()) for t in tags]) if tags else F.array().cast("array<string>")
    return F.arrays_overlap(_low(F.col("tags")), wanted)


def search(df: DataFrame, query: str | None, top_n: int, now: Column, tags: list[str] | None = None, vector: Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The best ``top_n`` current memories, best first, by a scan. Reads only: see ``store.search_and_reinforce``; ``store.search`` uses the index."""
    p = Probe.literal(df.sparkSession, query or "")
    return second_stage(text_search(df, query, cfg.over_fetch * top_n, now, cfg, p), p, top_n, now, tags, vector, cfg)


def second_stage(rows: DataFrame, p: Probe, top_n: int, now: Column, tags: list[str] | None = None, vector: Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The best ``top_n`` of the candidates."""
    if tags:
        rows = rows.where(has_tag(tags))
    rows = final_scores(rows.where(is_current()), p, now, vector, cfg)
    return rows.orderBy(F.desc("score"), "id").limit(top_n)


def best_of_each(rows: DataFrame, score: str, limit: int) -> DataFrame:
    """The best ``limit`` rows of each query_id, ties to the lower id; only the best of each task leave it."""
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), "id")
    return rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit).drop("_r")


def ranked_hits(rows: DataFrame, top_n: int, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Stage two for rows that are memories with the columns of their query: the best ``top_n`` current ones of each query, with a rank from 1."""
    rows = final_scores(rows.where(is_current()), Probe.of_columns(), now, F.col("query_vector"), cfg)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top_n)


def batch_search(df: DataFrame, queries: DataFrame, top_n: int, now: Column, cfg: EngineConfig = DEFAULT, index=None, fetch=None) -> DataFrame:
    """``search`` for every row of ``queries`` (query_id, query, query_vector), with a rank from 1; ids of ``df`` are unique.

    ``index`` holds the postings of ``df`` (see ``topk``), and ``fetch`` gives
    rows with an id the columns of ``df``; without them they are written for
    this search.  Work follows the postings that can matter, and is
    not memories times queries.
    """
    from .topk import LEAN, best_by_postings, postings

    queries = written(queries.withColumns(Probe.columns(normalize(F.col("query")))).where("_q <> ''"))
    limit = cfg.over_fetch * top_n
    if index is None:
        lean = written(df.select(LEAN))  # scored more than once
        hits = written(best_by_postings(postings(lean, day_of(now)), lambda found: lean.join(found, "id"), queries, limit, now, cfg))
        # the lean rows have what is dear to compute, so the memories give the rest only
        rows = df.drop(*LEAN[1:]).join(hits, "id").join(lean, "id").select(*df.columns, *[c for c in hits.columns if c != "id"])
    else:
        hits = written(best_by_postings(index, fetch, queries, limit, now, cfg))
        rows = fetch(hits) if fetch else df.join(hits, "id")
    return ranked_hits(rows.join(queries, "query_id"), top_n, now, cfg)


def by_tags(df: DataFrame, tags: list[str], limit: int, now: Column) -> DataFrame:
    """Memories with one of the tags, archived ones too, the strongest first."""
    return df.where(has_tag(tags)).withColumn("strength", current_strength(now)).orderBy(F.desc("strength"), "id").limit(limit)


def weak(df: DataFrame, threshold: float, limit: int, now: Column) -> DataFrame:
    """Memories below a strength, the weakest first."""
    rows = df.withColumn("strength", current_strength(now)).where(F.col("strength") < threshold)
    return rows.orderBy("strength", "id").limit(limit)
