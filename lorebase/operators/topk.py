"""Best memories by text for many queries, by postings and bounds.

Postings are cut into classes of memories of like strength and like size.  A
score has a part that the text decides and a part that the strength decides,
so a memory of a class can enter the best only if it shares enough of the
query's grams: with ``m`` shared grams the text's part is at most

    0.5 [m covers the whole query] + 0.5 m / (g + n - m) + 0.3 words(m) / w

(g and n the sizes of both sets, words(m) how many words so many grams can
cover).  A memory that shares m of g grams has one of any ``g - m + 1``, so only
the postings of the rarest of them are joined.  The bar is the score of the
last place among seeds: the memories with the query's very rarest grams, of
every class, and the strongest with a tag that it names.  What the bounds let
through is scored exactly, so results are those of a full scan.

All joins are equi-joins: grams with postings, words with the grams of tag
names, ids with memories.  Only the table of classes is broadcast; it has at
most CLASSES rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import day_of
from ..functions.text import inner_trigrams, strip
from ..plans.scratch import written
from .search import Probe, best_of_each, candidate_by_tag, lexical_scores

#: Seeds of a class, as a multiple of the places, and the most that a single gram may bring.
SEEDS, SEED_GRAM = 1, 4096
#: Of the grams that a memory need not have in its rarest, the share that is not read: more is less reading and looser bounds.
UNREAD = 0.5
#: Classes: nine of strength, pinned or not, and eleven of size.
CLASSES = 9 * 2 * 11
_EPS = 1e-9
_TINY = -1e30


@dataclass(frozen=True)
class Postings:
    """gram, cls, id, n, ls, rate; tag, cls, id, ls, rate; gram, cls, df; cls, at, top, slow, fast, least.

    The logarithm of a memory's strength is ``ls - rate * day``, with days
    since 1970, so a bound holds at any time.  A class has, at the day ``at``,
    logarithms of at most ``top``, rates from ``slow`` to ``fast`` and sizes
    from ``least``.
    """

    grams: DataFrame
    tags: DataFrame
    sizes: DataFrame
    classes: DataFrame

    def of_grams(self, grams: list[str]) -> Postings:
        """The same, for queries with these grams alone: the filter reaches the files."""
        return Postings(self.grams.where(F.col("gram").isin(grams)), self.tags, self.sizes.where(F.col("gram").isin(grams)), self.classes)


def _with_class(df: DataFrame, at: Column) -> DataFrame:
    """id, n, ls, rate, cls, trigrams, tags."""
    rate = F.when(F.col("is_pinned"), 0.0).otherwise(F.col("decay_rate") * (1 - F.col("importance") * 0.5))
    rows = df.select("id", "trigrams", "tags", F.size("trigrams").alias("n"), rate.alias("rate"), "is_pinned", F.coalesce(F.ln("base_strength"), F.lit(_TINY)).alias("b"), day_of(F.col("last_accessed_at")).alias("t"))
    rows = rows.withColumn("ls", F.col("b") + F.col("rate") * F.col("t"))
    strength = F.least(F.lit(4), F.greatest(F.lit(-4), F.floor((F.col("ls") - F.col("rate") * at) / 0.6931)))
    size = F.least(F.lit(10), F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))))
    cls = (strength + 4 + F.when(F.col("is_pinned"), 9).otherwise(0)) * 11 + size
    return rows.withColumn("cls", cls.cast("int")).select("id", "cls", "n", "ls", "rate", "trigrams", "tags")


def posting_rows(df: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories with their class, postings of grams, postings of tags); classes are told apart by their strength at the day ``at``, which may be any day."""
    rows = _with_class(df, at)
    grams = rows.select(F.explode("trigrams").alias("gram"), "cls", "id", "n", "ls", "rate")
    tags = rows.select(F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag"), "cls", "id", "ls", "rate")
    return rows, grams, tags


def postings(df: DataFrame, at: Column) -> Postings:
    """The postings of memories, written for the searches that follow."""
    rows, grams, tags = posting_rows(df, at)
    grams = written(grams)
    return Postings(grams, written(tags), written(sizes_of(grams)), written(classes_of(rows, at)))


#: What stage one reads of a memory.
LEAN = ["id", "content_normalized", "trigrams", "tags", "base_strength", "decay_rate", "importance", "last_accessed_at", "is_pinned"]


def sizes_of(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram", "cls").agg(F.count("*").alias("df"))


def classes_of(rows: DataFrame, at: Column) -> DataFrame:
    return rows.groupBy("cls").agg(at.alias("at"), F.max(F.col("ls") - F.col("rate") * at).alias("top"), F.min("rate").alias("slow"), F.max("rate").alias("fast"), F.min("n").alias("least"))


def strength_at(day: Column) -> Column:
    return F.exp(F.least(F.lit(700.0), F.col("ls") - F.col("rate") * day))


def _class_bounds(classes: DataFrame, day: Column) -> DataFrame:
    """cls, most (strength at ``day``), least (size); the parts of an index may each have a row for a class."""
    passed = day - F.col("at")
    most = F.col("top") - F.when(passed >= 0, F.col("slow")).otherwise(F.col("fast")) * passed
    return classes.groupBy("cls").agg(F.max(F.exp(F.least(F.lit(700.0), most))).alias("most"), F.min("least").alias("least"))


def _bit(position: Column) -> Column:
    """One of 64 bits for the place of a gram; grams that share one make bounds looser, never wrong."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def _facts(queries: DataFrame) -> DataFrame:
    """Adds what the bounds need of a query.

    _g and _w: numbers of grams and of words; _inner, _all: the grams of a whole
    match, their number and their bits; _words: the bits of each word;
    _least: how many grams each number of words has at least.
    """
    q = queries.withColumn("_g", F.size("_grams")).withColumn("_w", F.size("_long"))
    bits = lambda grams: F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: s.bitwiseOR(_bit(F.array_position("_grams", g) - 1)))
    q = q.withColumn("_in", inner_trigrams(F.col("_q"))).withColumn("_of", F.transform("_long", inner_trigrams))
    q = q.withColumn("_inner", F.size("_in")).withColumn("_all", bits(F.col("_in"))).withColumn("_words", F.transform("_of", bits))
    every = F.flatten("_of")
    times = F.transform(F.array_distinct(every), lambda g: F.size(F.filter(every, lambda x: x == g)))
    q = q.withColumn("_often", F.greatest(F.lit(1), F.coalesce(F.array_max(times), F.lit(1)))).withColumn("_twice", F.size(every) - F.size(F.array_distinct(every)))
    sizes = F.array_sort(F.transform("_of", F.size))
    sums = F.transform(F.sequence(F.lit(1), F.greatest("_w", F.lit(1))), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    # words share grams: no gram is in more than _often of them, and _twice is all that they share
    q = q.withColumn("_least", F.when(F.col("_w") > 0, F.transform(sums, lambda s: F.greatest(F.ceil(s / F.col("_often")), s - F.col("_twice")))).otherwise(F.array().cast("array<bigint>")))
    return q.drop("_in", "_of", "_often", "_twice")


FACTS = ["query_id", "_g", "_w", "_inner", "_all", "_words", "_least"]


def _text_bound(m: Column, n: Column, bits: Column | None = None) -> tuple[Column, Column]:
    """(the most of the text's part of a score without tags, whether the text can be relevant) with at most m shared grams, of those bits, of a memory with n."""
    fuzzy = m / F.greatest(F.col("_g") + F.greatest(n, m) - m, F.lit(1))
    covered = F.size(F.filter("_least", lambda s: s <= m))
    whole = (m >= F.col("_inner")) & (F.col("_inner") > 0)
    if bits is not None:
        covered = F.least(covered, F.size(F.filter("_words", lambda w: w.bitwiseAND(bits) == w)))
        whole = whole & (F.col("_all").bitwiseAND(bits) == F.col("_all"))
    share = F.when(F.col("_w") > 0, covered / F.col("_w")).otherwise(0.0)
    return F.when(whole, 0.5).otherwise(0.0) + 0.5 * fuzzy + 0.3 * share, whole | (covered > 0) | (fuzzy > 0.05 - 1e-6)


Fetch = Callable[[DataFrame], DataFrame]


def _scored(fetch: Fetch, found: DataFrame, queries: DataFrame, now: Column, cfg: EngineConfig) -> DataFrame:
    """query_id, id, _text_score (null where nothing is relevant, or the mode leaves the memory out) of pairs (query_id, id)."""
    rows = fetch(found).join(queries, "query_id")
    if cfg.candidate_mode == "substring_or_tag":
        rows = rows.where(F.contains(F.col("content_normalized"), F.col("_q")) | candidate_by_tag(Probe.of_columns()))
    return lexical_scores(rows, Probe.of_columns(), now).select("query_id", "id", "_text_score")


def best_by_postings(ix: Postings, fetch: Fetch, queries: DataFrame, limit: int, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, id, _text_score: the relevant ones among the best ``limit`` of each query.

    queries: query_id, query and the columns of ``Probe.columns``, no blank ones.
    fetch: pairs (query_id, id) with the memories' columns.
    """
    asked = written(_facts(queries.withColumn("_short", F.length(strip(F.col("query"))) < 3)))
    return _best_long(ix, fetch, asked.where("not _short"), limit, now, cfg).unionByName(_best_short(ix, fetch, asked.where("_short"), limit, now, cfg))


def _best_long(ix: Postings, fetch: Fetch, asked: DataFrame, limit: int, now: Column, cfg: EngineConfig) -> DataFrame:
    day = day_of(now)
    bounds = _class_bounds(ix.classes, day)
    grams = asked.select("query_id", F.posexplode("_grams").alias("at", "gram")).withColumn("bit", _bit(F.col("at"))).drop("at").join(ix.sizes.groupBy("gram", "cls").agg(F.sum("df").alias("df")), "gram")
    rare = Window.partitionBy("query_id", "cls").orderBy("df", "gram")
    grams = grams.withColumn("rank", F.row_number().over(rare)).withColumn("upto", F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0)))
    grams = written(grams)

    named = _named_tags(ix, asked)
    tagged = written(named.join(ix.tags, "tag").select("query_id", "id", strength_at(day).alias("s")).distinct())
    strongest = best_of_each(tagged, "s", limit).select("query_id", "id")
    seeds = grams.where((F.col("upto") <= SEEDS * limit) | ((F.col("rank") == 1) & (F.col("df") <= SEED_GRAM)))
    seeds = seeds.select("query_id", "gram", "cls").join(ix.grams.select("gram", "cls", "id"), ["gram", "cls"]).select("query_id", "id")
    seeds = written(seeds.unionByName(strongest).distinct())
    first = best_of_each(_scored(fetch, seeds, asked, now, cfg).where("_text_score is not null"), "_text_score", limit)
    bar = first.groupBy("query_id").agg(F.count("*").alias("k"), F.min("_text_score").alias("bar")).where(F.col("k") >= limit).select("query_id", "bar")

    # how many grams a memory of each class must share
    facts = asked.select(FACTS)
    plan = facts.join(bar, "query_id", "left").join(named.select("query_id").distinct().withColumn("_bonus", F.lit(0.3)), "query_id", "left")
    plan = plan.withColumn("_bonus", F.coalesce("_bonus", F.lit(0.0))).withColumn("bar", F.coalesce("bar", F.lit(_TINY)) - _EPS)
    plan = written(plan)
    need = F.col("bar") - 0.2 * F.col("most") - F.col("_bonus")

    def enough(m):
        most, relevant = _text_bound(m, F.col("least"))
        return (most >= need) & relevant

    first_m = F.get(F.filter(F.sequence(F.lit(1), F.greatest("_g", F.lit(1))), enough), F.lit(0))
    at_least = plan.crossJoin(F.broadcast(bounds)).withColumn("m", first_m).where("m is not null")  # CLASSES rows
    # of the other m - 1 grams, the commonest are left out, as a share
    at_least = at_least.select("query_id", "cls", "_g", F.floor((F.col("m") - 1) * UNREAD).alias("unread"))
    wanted = written(grams.join(at_least, ["query_id", "cls"]).withColumn("read", F.col("rank") <= F.col("_g") - F.col("unread")))
    # grams that no memory of the class has are neither read nor missing
    missing = wanted.where("not read").groupBy("query_id", "cls").agg(F.count("*").alias("unread"), F.bit_or("bit").alias("out"))
    met = wanted.where("read").select("query_id", "cls", "gram", "bit").join(ix.grams, ["gram", "cls"])
    met = met.groupBy("query_id", "id").agg(F.count("*").alias("c"), F.bit_or("bit").alias("bits"), *(F.max(x).alias(x) for x in ("cls", "n", "ls", "rate")))
    met = met.join(plan, "query_id").join(missing, ["query_id", "cls"], "left")
    most, relevant = _text_bound(F.least("_g", F.col("c") + F.coalesce("unread", F.lit(0))), F.col("n"), F.col("bits").bitwiseOR(F.coalesce("out", F.lit(0))))
    found = met.where(relevant & (most + F.col("_bonus") + 0.2 * strength_at(day) >= F.col("bar"))).select("query_id", "id")
    # the text may share nothing with the query but still have a tag that it names
    by_tag = tagged.join(plan.select("query_id", "bar"), "query_id").where(0.3 + 0.2 * F.col("s") >= F.col("bar")).select("query_id", "id")
    every = written(found.unionByName(by_tag).unionByName(seeds).distinct())
    return best_of_each(_scored(fetch, every, asked, now, cfg), "_text_score", limit).where("_text_score is not null")


def _named_tags(ix: Postings, asked: DataFrame) -> DataFrame:
    """query_id, tag: the tags that contain a word of the query; words and names meet in the word's first trigram."""
    names = ix.tags.select("tag").distinct().select("tag", F.explode(inner_trigrams(F.col("tag"))).alias("key"))
    said = asked.select("query_id", F.explode(F.array_distinct("_long")).alias("word")).withColumn("key", F.substring("word", 1, 3))
    return written(said.join(names, "key").where(F.contains(F.col("tag"), F.col("word"))).select("query_id", "tag").distinct())


def _best_short(ix: Postings, fetch: Fetch, asked: DataFrame, limit: int, now: Column, cfg: EngineConfig) -> DataFrame:
    """Queries of one or two characters: a text contains them if one of its grams does."""
    shared = written(asked.select("query_id", F.explode("_grams").alias("gram")).join(ix.grams.select("gram", "id"), "gram").select("query_id", "id").distinct())
    parts = F.array(*[F.substring("gram", i, k) for k in (1, 2) for i in range(1, 5 - k)])
    holding = ix.sizes.select("gram").distinct().select("gram", F.explode(F.array_distinct(parts)).alias("_q"))
    inside = asked.select("query_id", "_q").join(holding, "_q").join(ix.grams.select("gram", "id"), "gram").select("query_id", "id")
    some = shared.select("query_id").distinct().withColumn("_any", F.lit(True))
    pairs = shared.withColumn("_shared", F.lit(True)).unionByName(inside.withColumn("_shared", F.lit(False))).groupBy("query_id", "id").agg(F.max("_shared").alias("_shared"))
    rows = fetch(written(pairs)).join(asked, "query_id").join(some, "query_id", "left")
    text_has = F.contains(F.col("content_normalized"), F.col("_q"))
    by_tag = candidate_by_tag(Probe.of_columns())
    if cfg.candidate_mode == "substring_or_tag":
        rows = rows.where(text_has | by_tag)
    else:
        rows = rows.where(F.col("_shared") | (F.col("_any").isNull() & text_has) | by_tag)
    scored = lexical_scores(rows, Probe.of_columns(), now).select("query_id", "id", "_text_score")
    return best_of_each(scored, "_text_score", limit).where("_text_score is not null")
