"""Maintenance: decay and prune, similar pairs, consolidation, reindexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.strength import current_strength
from ..functions.text import jaccard_of, normalize, searchable, trigrams
from ..functions.vector import cosine, norm
from ..plans.scratch import dropped_after, written
from .set_join import LEAST_THRESHOLD, by_shares, first_met, met, met_within, shared, signatures, similar_sets, sketches, sketches_admit
from .vector_join import equal_vector, near_vectors


def prune(df: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """What stays: memories of at least the threshold's strength."""
    return df.where(current_strength(now) >= cfg.prune_threshold)


def decay_report(df: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row: counts and average strengths before and after pruning. Decayed strengths are never stored."""
    s = df.select(current_strength(now).alias("s"))
    keep = F.col("s") >= cfg.prune_threshold
    return s.agg(
        F.count("*").alias("total"),
        F.count_if(~keep).alias("pruned"),
        F.coalesce(F.avg("s"), F.lit(0.0)).alias("average_before"),
        F.coalesce(F.avg(F.when(keep, F.col("s"))), F.lit(0.0)).alias("average_after"),
    )


def similar_pairs(df: DataFrame, threshold: float, cfg: EngineConfig = DEFAULT, use_vectors: bool = False) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of rows (id, content_normalized, embedding) that reach the threshold.

    Rows with equal trigrams are one class; classes are joined exactly by the
    parts of their trigrams (see ``set_join``), and similar classes expand to
    their rows.  With vectors, pairs of rows that both have one are blended:
    ``wc * cosine + wj * jaccard`` (see ``_blended_pairs``).
    """
    wc, wj = cfg.pair_weights
    rows = _classed(df, use_vectors)
    if not use_vectors:
        return _class_pairs(rows, threshold).where(F.col("similarity") >= threshold)
    blended = rows.where("known")
    found = written(_blended_pairs(blended, threshold, cfg))
    vector = lambda some, c: some.select(F.col("id").alias(c), F.col("embedding").alias(f"_{c}"))

    def mixed(pairs, left):
        both = pairs.join(vector(left, "a"), "a").join(vector(blended, "b"), "b")
        return both.select("a", "b", (wc * cosine(F.col("_a"), F.col("_b")) + wj * F.col("similarity")).alias("similarity")).where(F.col("similarity") >= threshold)

    # pairs with a row that has no vector: Jaccard alone
    return by_shares(found, blended, mixed).unionByName(_class_pairs(rows, threshold, alone=True).where(F.col("similarity") >= threshold))


def _classed(df: DataFrame, vectors: bool = False) -> DataFrame:
    """id, grams, n, class of the rows with trigrams, and with ``vectors`` embedding and known; rows of a class have equal trigrams, and with ``vectors`` all have one or none.

    A trigram is the number that its three code points make, of 21 bits each.
    """
    char = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    number = lambda g: F.shiftleft(char(g, 1), 42).bitwiseOR(F.shiftleft(char(g, 2), 21)).bitwiseOR(char(g, 3))
    rows = df.select("id", F.transform(trigrams(F.col("content_normalized")), number).alias("grams"), *(["embedding"] if vectors else []))
    rows = rows.withColumn("n", F.size("grams")).where("n > 0").withColumn("known", F.col("embedding").isNotNull() if vectors else F.lit(False))
    return written(rows.withColumn("class", F.unhex(F.sha2(F.concat_ws(",", F.array_sort("grams").cast("array<string>"), F.col("known").cast("string")), 256))))


def _classes(rows: DataFrame) -> DataFrame:
    """class, id (the least), items, n, members, known of rows (id, grams, n, class, known)."""
    least = [F.min("id").alias("id"), F.min_by("grams", "id").alias("items"), F.min("n").alias("n"), F.count("*").alias("members"), F.min("known").alias("known")]
    return written(rows.groupBy("class").agg(*least))


def _class_pairs(rows: DataFrame, threshold: float, alone: bool = False) -> DataFrame:
    """(a, b, similarity) of rows (id, grams, n, class, known) that reach a Jaccard threshold; ``alone``: but for pairs of two that are known."""
    classes = _classes(rows)
    near = similar_sets(classes.select("id", "items", "n", (2 * F.col("members") + F.col("known").cast("long")).alias("mark")), threshold)
    if alone:
        near = near.where("_ma % 2 = 0 or _mb % 2 = 0")
    near = near.select("a", "b", jaccard_of(F.col("both"), F.col("_na"), F.col("_nb")).alias("similarity"), ((F.col("_ma") > 3) | (F.col("_mb") > 3)).alias("several"))
    # only classes of several rows are expanded
    member = written(rows.select("class", "id").join(classes.where("members > 1").select("class", F.col("id").alias("least"), "known"), "class").select("least", "id", "known"))
    left, right = member.select(F.col("least").alias("a"), F.col("id").alias("x")), member.select(F.col("least").alias("b"), F.col("id").alias("y"))
    several = near.where("several").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "similarity")
    across = several.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    equals = member.where("not known") if alone else member
    one, two = equals.alias("one"), equals.toDF(*equals.columns).alias("two")
    equal = one.join(two, (F.col("one.least") == F.col("two.least")) & (F.col("one.id") < F.col("two.id")))
    equal = equal.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.where("not several").select("a", "b", "similarity").unionByName(across).unionByName(equal)


def _blended_pairs(rows: DataFrame, threshold: float, cfg: EngineConfig) -> DataFrame:
    """(a, b, similarity): pairs of rows (id, grams, embedding, n, class), all with vectors, that may reach the blended threshold, with their Jaccard similarity.

    A blend of parts bounds each by the other: however equal the sets are, the
    vectors must be so near that they meet in the cells (see ``vector_join``),
    and the sizes and sketches of the sets must admit what the vectors lack.
    Only where the threshold asks nothing of the vectors, sets of a Jaccard
    similarity of at least ``split`` meet in the parts of their trigrams.
    """
    wc, wj = cfg.pair_weights
    least = max((threshold - wc) / wj - 1e-6, 0.0)  # of Jaccard, where the cosine is 1
    cosine_least, found = (threshold - wj) / wc - 1e-6, None
    if cosine_least <= 0:
        split = max(least, LEAST_THRESHOLD)
        cosine_least, found = (threshold - wj * split) / wc - 1e-6, _class_pairs(rows, split)
    drawn = rows.select("id", "embedding", "n").join(sketches(rows.select("id", F.col("grams").alias("items"), "n")), "id")
    sets = rows.select("id", F.col("grams").alias("items"), "n")
    near = shared(near_vectors(drawn, cosine_least, may=sketches_admit(least)), sets, least)
    near = near.select("a", "b", jaccard_of(F.col("both"), F.col("_na"), F.col("_nb")).alias("similarity"))
    return near if found is None else found.unionByName(near).dropDuplicates(["a", "b"])


def leader_clusters(pairs: DataFrame) -> DataFrame:
    """(id, leader) of all ids in ``pairs`` (a, b): greedy clusters in id order.

    An id leads unless a smaller neighbour leads; members join their smallest
    leading neighbour; clusters are not transitive.  Each round settles the ids
    whose smaller neighbours are settled, and only edges that still matter go
    on: those from an open id, and those of an open id whose smaller neighbour
    leads settle it at once.  Every round settles at least the smallest open
    id, so rounds end, however long a chain is.
    """
    edges = written(pairs.select("a", "b").distinct())
    open_edges = edges
    leads = None  # ids that lead
    state = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    todo = written(state)
    while todo.limit(1).count():
        # open ids without an open or leading smaller neighbour lead
        new = written(todo.join(open_edges.select(F.col("b").alias("id")), "id", "left_anti"))
        led = written(open_edges.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        leads = new if leads is None else leads.unionAll(new)
        done = new.unionAll(led)
        todo = written(todo.join(done, "id", "left_anti"))
        # an edge matters while both ends are open
        open_edges = written(open_edges.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti"))
    if leads is None:
        return state.select("id", F.col("id").alias("leader"))
    of = edges.join(leads.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    out = state.join(of.withColumnRenamed("b", "id"), "id", "left")
    return out.select("id", F.coalesce("leader", "id").alias("leader"))


def set_leaders(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, leader) of rows (id, items, n), as ``leader_clusters`` gives them of all similar pairs, without all of these.

    Copies with small changes are all similar to each other, so their pairs
    grow with the square of their number.  Hubs are sets that others find as
    the least with a signature of theirs; all that is similar to hubs is found.
    A hub without a smaller neighbour leads, so its neighbours do not, and no
    pair of two of these says anything about leaders.  What is left is joined
    with itself, and what leads of it with those neighbours.
    """
    near = lambda pairs: shared(pairs, sets, threshold).where(jaccard_of(F.col("both"), F.col("_na"), F.col("_nb")) >= threshold).select("a", "b")
    named = lambda df, c: df.select(F.col(c).alias("id")).distinct()
    with dropped_after(sets.sparkSession) as kept:
        keys = signatures(sets, threshold)
        hubs = written(named(near(first_met(keys, threshold)).groupBy("b").agg(F.min("a").alias("a")), "a"))
        around = written(near(met(keys.join(hubs, "id", "left_semi"), keys, threshold)))
        first = written(hubs.join(named(around, "b"), "id", "left_anti"))
        sure = written(around.join(first.select(F.col("id").alias("a")), "a", "left_semi"))
        led = written(named(sure, "b"))
        rest = written(keys.join(first, "id", "left_anti").join(led, "id", "left_anti"))
        among = leader_clusters(near(met_within(rest, threshold)))
        among = written(among)
        behind = rest.join(among.where("id <> leader").select("id"), "id", "left_anti")
        later = written(near(met(behind, keys.join(led, "id", "left_semi"), threshold)))
        # an end that is not led leads
        edges = sure.unionAll(later.join(led.select(F.col("id").alias("b")), "b", "left_semi").join(led.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"))
        of = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
        alone = first.unionAll(named(later.select("a").unionAll(later.select(F.col("b").alias("a"))), "a").join(led, "id", "left_anti"))
        alone = alone.join(among.select("id"), "id", "left_anti").distinct()
        kept.append(written(of.unionAll(among).unionAll(alone.select("id", F.col("id").alias("leader")))))
    return kept[0]


def similar_clusters(df: DataFrame, threshold: float, cfg: EngineConfig = DEFAULT, use_vectors: bool = False) -> DataFrame:
    """(id, leader) as ``leader_clusters(similar_pairs(...))`` gives them, without a pair for every two rows of a class.

    Rows of a class have the same neighbours and are neighbours themselves.  So
    none but the least of them can lead: if it does, the others join it, and if
    a smaller neighbour does, that is theirs too.  Leaders are found among the
    least rows of classes, and the others follow.  With vectors, rows of a class
    have equal vectors too, or none; those with a zero vector are classes of
    their own, for they are not like each other.
    """
    if use_vectors:
        rows = _classed(df, True)
        vector = F.when(F.col("embedding").isNull() | (norm(F.col("embedding")) > 0), equal_vector(F.col("embedding"))).otherwise(F.concat(F.lit("of "), F.col("id").cast("string")))
        rows = written(rows.select("id", F.sha2(F.concat_ws("\u0001", F.hex("class"), vector), 256).alias("class")))
        classes = written(rows.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("members")))
        led = leader_clusters(similar_pairs(df.join(classes.select(F.col("least").alias("id")), "id", "left_semi"), threshold, cfg, True)).withColumnRenamed("id", "least")
        of = classes.join(led, "least", "left").where("members > 1 or leader is not null")
        return rows.join(of.select("class", F.coalesce("leader", "least").alias("leader")), "class").select("id", "leader")
    with dropped_after(df.sparkSession) as kept:
        rows = _classed(df)
        classes = _classes(rows)
        led = set_leaders(classes.select("id", "items", "n"), threshold).withColumnRenamed("id", "least")
        of = classes.select("class", F.col("id").alias("least"), "members").join(led, "least", "left").where("members > 1 or leader is not null")
        kept.append(written(rows.select("id", "class").join(of.select("class", F.coalesce("leader", "least").alias("leader")), "class").select("id", "leader")))
    return kept[0]


def consolidate(df: DataFrame, now: Column, cfg: EngineConfig = DEFAULT, use_vectors: bool = False) -> DataFrame:
    """id, cluster, survivor, action (keep: reinforced once; archive) of the memories in clusters of two and more.

    Archived memories take no part.  The strongest of a cluster survives; the
    others are archived with superseded_by, and keep an open validity.
    """
    live = df.where(~F.col("is_archived"))
    found = similar_clusters(live, cfg.consolidate_threshold, cfg, use_vectors)
    rows = written(live.select("id", current_strength(now).alias("strength")).join(found, "id"))
    best = rows.groupBy("leader").agg(F.min(F.struct((-F.col("strength")).alias("s"), "id"))["id"].alias("survivor"), F.count("*").alias("members")).where("members > 1")
    action = F.when(F.col("id") == F.col("survivor"), "keep").otherwise("archive")
    return rows.join(best, "leader").select("id", F.col("leader").alias("cluster"), "survivor", action.alias("action"))


def apply_consolidation(df: DataFrame, plan: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    rows = df.join(plan.select("id", "survivor", "action"), "id", "left")
    keep, gone = F.col("action") == "keep", F.col("action") == "archive"
    count = F.col("access_count") + 1
    rows = rows.withColumn("base_strength", F.when(keep, F.col("base_strength") + cfg.reinforcement / F.sqrt(count)).otherwise(F.col("base_strength")))
    rows = rows.withColumn("last_accessed_at", F.when(keep, now).otherwise(F.col("last_accessed_at")))
    rows = rows.withColumn("access_count", F.when(keep, count).otherwise(F.col("access_count")).cast("int"))
    rows = rows.withColumn("superseded_by", F.when(gone, F.col("survivor")).otherwise(F.col("superseded_by")))
    rows = rows.withColumn("is_archived", F.coalesce(gone, F.lit(False)) | F.col("is_archived"))
    return rows.select(df.columns)


def reindex(df: DataFrame, embedder=None) -> DataFrame:
    """Index text and trigrams computed anew; vectors from the lower-cased whole text, if there is an embedder."""
    out = df.withColumn("content_normalized", searchable(F.col("title"), F.col("summary"), F.col("tags")))
    out = out.withColumn("trigrams", trigrams(F.col("content_normalized")))
    if embedder is not None and embedder.available:
        out = out.withColumn("embedding", embedder.embed(normalize(F.concat_ws(" ", "title", "summary", "content"))))
    return out


def reindex_report(df: DataFrame) -> DataFrame:
    """One row: memories, trigrams of their whole texts, and vectors."""
    grams = F.size(trigrams(F.concat_ws(" ", "title", "summary", "content")))
    return df.agg(F.count("*").alias("memories"), F.coalesce(F.sum(grams), F.lit(0)).alias("trigrams_generated"), F.count("embedding").alias("embeddings"))


def saved_percent(before: int, after: int) -> float:
    return 0.0 if before == 0 else (1 - after / before) * 100

