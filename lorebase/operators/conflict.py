"""Conflict-aware ingestion: reinforce duplicates, supersede similar memories, coexist with related ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import current_strength, is_current, reinforced
from ..plans.scratch import written
from .search import batch_search, has_tag

HITS = 10
#: The rows of its batch that a row is compared with at a time; rows with more wait longer, see ``settled``.
NEIGHBOURS = 50


def classify(df: DataFrame, incoming: DataFrame, now: Column, cfg: EngineConfig = DEFAULT, index=None, fetch=None) -> DataFrame:
    """id, action, target (the duplicate, or null), superseded (array of ids), hits (array of ids) of every incoming row.

    incoming: id, title, summary, embedding, and optionally query_vector: the
    vector of title and summary alone, with which a row is searched (what is
    stored is the vector of the whole).  Each row is judged against ``df``
    alone (see ``settled`` for rows of one batch), by its ten best hits; "first" means first by score.  An
    old memory that several rows would supersede goes to the lowest id; the
    others then coexist.  index, fetch: see ``batch_search``.
    """
    found = batch_search(df, _queries(incoming), HITS, now, cfg, index, fetch).select("query_id", "id", "rank", "semantic_score", is_current().alias("current"))
    every = found.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("hits"))
    hits = found.where("id <> query_id")
    sem = F.col("semantic_score")
    dup = F.min(F.when(sem >= cfg.duplicate, F.struct("rank", "id")))["id"]
    near = F.min(F.when(sem >= cfg.coexist, F.col("rank")))
    per = hits.groupBy("query_id").agg(dup.alias("target"), near.alias("near"))
    old = hits.where((sem >= cfg.supersede) & (sem < cfg.duplicate) & F.col("current")).join(per.where("target is null").select("query_id"), "query_id")
    old = old.groupBy("id").agg(F.min("query_id").alias("query_id")).groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("superseded"))
    out = incoming.select("id")
    for part in (per, old, every):
        out = out.join(part.withColumnRenamed("query_id", "id"), "id", "left")
    action = (
        F.when(F.col("target").isNotNull(), "ReinforcedExisting").when(F.col("superseded").isNotNull(), "StoredWithSupersede").when(F.col("near").isNotNull(), "StoredCoexist").otherwise("StoredNew")
    )
    none = F.array().cast(old.schema["superseded"].dataType)
    return out.select("id", action.alias("action"), "target", F.coalesce("superseded", none).alias("superseded"), F.coalesce("hits", none).alias("hits"))


def _queries(incoming: DataFrame) -> DataFrame:
    """query_id, query, query_vector: what each incoming row is searched with."""
    vector = F.col("query_vector") if "query_vector" in incoming.columns else F.col("embedding")
    return incoming.select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "summary").alias("query"), vector.alias("query_vector"))


def settled(incoming: DataFrame, verdicts: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Those verdicts of ``classify`` that storing the rows of a batch one by one, by id, would reach as well; the others wait for a later state.

    A row waits for the rows before it that would supersede one of its hits, and
    for those before it that would be stored and be as similar to it as
    ``cfg.batch_order``.  Rows that only reinforce store nothing, so no row
    waits for them, unless they wait for a superseding one themselves: all
    copies of a memory settle together.  A row whose NEIGHBOURS most similar
    rows come after it may have others before it, and waits until it is first.
    The first row never waits, so rounds end.
    """
    gone = supersede_edges(verdicts).select("old_id", F.col("new_id").alias("by"))
    waits = written(verdicts.select("id", F.explode("hits").alias("old_id")).join(gone, "old_id").where("by < id").select("id").distinct())
    if cfg.batch_order > 0 and not _queries(incoming).where("query_vector is not null").limit(1).count():
        return verdicts.join(waits, "id", "left_anti")  # without vectors nothing is similar
    open_rows = verdicts.where("target is null").select("id").unionByName(waits).distinct()
    unsure = written(incoming.drop("query_vector").join(open_rows, "id", "left_semi"))
    near = batch_search(unsure, _queries(incoming), NEIGHBOURS + 1, now, cfg).where((F.col("id") != F.col("query_id")) & (F.col("semantic_score") >= cfg.batch_order))
    near = near.groupBy(F.col("query_id").alias("id")).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    first = incoming.agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    held = near.join(first, "id", "left").where((F.col("least") < F.col("id")) | ((F.col("n") >= NEIGHBOURS) & F.col("first").isNull()))
    return verdicts.join(waits.unionByName(held.select("id")), "id", "left_anti")


def supersede_edges(verdicts: DataFrame) -> DataFrame:
    """(old_id, new_id) of all supersessions."""
    return verdicts.select(F.explode("superseded").alias("old_id"), F.col("id").alias("new_id"))


def apply(df: DataFrame, incoming: DataFrame, verdicts: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The memories after a batch: ``df`` updated, and the incoming rows that are stored.

    incoming has the columns of ``df``.  Every hit is reinforced once, as any
    search does; a duplicate is reinforced once more, and its content replaced
    by a longer one.  With ``compat_lost_update`` that replacement also drops
    the reinforcements.
    """
    named = incoming.select(F.col("id").alias("_new"), F.col("content").alias("_text"))
    dups = verdicts.where("target is not null").join(named, verdicts["id"] == F.col("_new"))
    dups = dups.groupBy(F.col("target").alias("_id")).agg(F.count("*").alias("_times"), F.min_by("_text", F.struct((-F.length("_text")).alias("n"), "_new")).alias("_text"))
    seen = verdicts.select(F.explode("hits").alias("_hit")).groupBy("_hit").agg(F.count("*").alias("_seen"))
    gone = supersede_edges(verdicts).withColumnRenamed("old_id", "_old")
    rows = df.join(dups, df["id"] == F.col("_id"), "left").join(seen, df["id"] == F.col("_hit"), "left").join(gone, df["id"] == F.col("_old"), "left")
    longer = F.coalesce((F.trim("_text") != "") & (F.length("_text") > F.length(F.coalesce("content", F.lit("")))), F.lit(False))
    times = F.coalesce("_times", F.lit(0)) + F.coalesce("_seen", F.lit(0))
    counted = (times > 0) & ~(longer & F.lit(cfg.compat_lost_update))
    old = F.col("_old").isNotNull()
    new = {
        "base_strength": F.when(counted, reinforced(F.col("base_strength"), F.col("access_count"), times, cfg.reinforcement)).otherwise(F.col("base_strength")),
        "access_count": F.when(counted, F.col("access_count") + times).otherwise(F.col("access_count")).cast("int"),
        "last_accessed_at": F.when(counted, now).otherwise(F.col("last_accessed_at")),
        "content": F.when(longer, F.col("_text")).otherwise(F.col("content")),
        "valid_until": F.when(old, now).otherwise(F.col("valid_until")),
        "superseded_by": F.when(old, F.col("new_id")).otherwise(F.col("superseded_by")),
        "is_archived": old | F.col("is_archived"),
    }
    kept = rows.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])
    stored = incoming.join(verdicts.where("target is null").select("id", F.col("superseded").alias("_sup")), "id")
    stored = stored.withColumn("superseded_ids", F.when(F.size("_sup") > 0, F.col("_sup")).otherwise(F.col("superseded_ids"))).withColumn("valid_from", now)
    return kept.unionByName(stored.select(df.columns))


def tag_history(df: DataFrame, tag: str, now: Column, include_archived: bool = True) -> DataFrame:
    """id, title, status, validity, superseded_by of memories with the tag, the latest first."""
    rows = df.where(has_tag([tag])).where(F.lit(include_archived) | is_current())
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    status = F.when(is_current(), "CURRENT").otherwise("Superseded")
    validity = F.concat(day("valid_from"), F.lit(" to "), F.coalesce(day("valid_until"), F.lit("present")))
    return rows.orderBy(F.desc("valid_from"), "id").select("id", "title", status.alias("status"), validity.alias("validity"), "superseded_by", current_strength(now).alias("strength"))


def supersede_chains(df: DataFrame, with_path: bool = False) -> DataFrame:
    """id, head, depth, cyclic (and path) of all memories (id, superseded_by): where the chain of supersessions from each one ends.

    A memory that nothing supersedes is its own head, at depth 0; a pointer to
    no memory counts as none.  Memories on a cycle, or with one ahead, have no
    head and no depth.  ``path`` has the ids from the memory to its head, and so
    grows with the chain; it is null with the head.

    Each round doubles how far pointers reach, so a chain of length n takes
    log n joins, and only memories that are not at a head yet take part.  A
    round in which none arrives leaves nothing but cycles.
    """
    ids = df.select(F.col("id").alias("superseded_by"))
    known = df.select("id", "superseded_by").join(ids, "superseded_by", "left_semi").withColumn("_old", F.lit(True))
    at = df.select("id").join(known, "id", "left").select("id", F.coalesce("superseded_by", "id").alias("to"), F.when(F.col("_old"), 1).otherwise(0).cast("long").alias("depth"), F.col("_old").isNull().alias("head"))
    at = at.withColumn("path", F.when(F.col("head"), F.array("id")).otherwise(F.array("id", "to"))) if with_path else at
    at = written(at)
    ends = at.where("head").select(F.col("id").alias("to"), F.lit(True).alias("_end"))
    at = written(at.join(ends, "to", "left").withColumn("head", F.coalesce("_end", F.lit(False))).drop("_end"))
    settled, going = at.where("head"), at.where("not head")
    left = going.count()
    while left:
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("head").alias("_head"), *([F.col("path").alias("_path")] if with_path else []))
        path = [F.concat("path", F.slice("_path", F.lit(2), F.size("_path"))).alias("path")] if with_path else []
        going = written(going.join(ahead, "to").select("id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_head").alias("head"), *path))
        arrived = going.where("head")
        still = going.where("not head")
        n = still.count()
        settled = settled.unionByName(arrived)
        at, going = settled.unionByName(still), still
        if n == left:
            break
        left = n
    none = F.when(F.col("head"), F.col("to"))
    extra = [F.when(F.col("head"), F.col("path")).alias("path")] if with_path else []
    return at.select("id", none.alias("head_id"), F.when(F.col("head"), F.col("depth")).alias("depth"), (~F.col("head")).alias("cyclic"), *extra).withColumnRenamed("head_id", "head")
