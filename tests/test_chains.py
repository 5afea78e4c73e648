"""Chains of supersessions, clusters by classes, and batches that are run again."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorebase.api import Engine
from lorebase.functions import strength
from lorebase.operators import maintain
from lorebase.operators.conflict import supersede_chains
from lorebase.operators.search import weak
from lorebase.plans import scratch
from lorebase.sources.store import MemoryStore
from lorebase.streaming.ingest import reinforce_stream

NOW = datetime(2024, 2, 1)


def test_chains(spark):
    """Trees of pointers, long chains, pointers to nothing and to itself, cycles with tails."""
    rng = random.Random(4)
    nxt = {i: rng.choice([None, *range(i + 1, min(i + 4, 90))]) if i < 89 else None for i in range(90)}
    nxt |= {i: i + 1 for i in range(200, 260)} | {260: None, 300: 999, 301: 301, 310: 311, 311: 312, 312: 310, 313: 310, 314: 313}
    df = spark.createDataFrame(list(nxt.items()), "id long, superseded_by long")

    def walk(i):
        path = [i]
        while nxt[path[-1]] is not None and nxt[path[-1]] in nxt:
            if nxt[path[-1]] in path:
                return None
            path.append(nxt[path[-1]])
        return path

    got = {r.id: r for r in supersede_chains(df, with_path=True).collect()}
    assert len(got) == len(nxt)
    for i in nxt:
        path = walk(i)
        want = (None, None, True, None) if path is None else (path[-1], len(path) - 1, False, path)
        assert (got[i].head, got[i].depth, got[i].cyclic, got[i].path) == want, i
    assert supersede_chains(df.where("false")).count() == 0


def rows_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content_normalized string")
    return df.withColumn("embedding", F.lit(None).cast("array<float>"))


def test_clusters_by_classes(spark):
    """As the clusters of all pairs, with classes of equal texts on both sides of similar ones."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefg ") for _ in range(60)) for _ in range(5)]
    texts = []
    for _ in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            t[rng.randrange(60)] = "z"
        texts.append("".join(t))
    df = rows_of(spark, [*texts, "", "", "alone here"]).cache()
    plain = lambda rows: sorted((r.id, r.leader) for r in rows.collect())
    assert plain(maintain.similar_clusters(df, 0.8)) == plain(maintain.leader_clusters(maintain.similar_pairs(df, 0.8)))


def test_very_many_equal_memories(spark):
    """No pair for every two of 100,000 equal memories."""
    df = spark.range(100_000).select("id", F.lit("the same words again").alias("content_normalized"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(NOW).alias("last_accessed_at"))
    df = df.withColumns({"is_archived": F.lit(False), "is_pinned": F.lit(False), "base_strength": F.when(F.col("id") == 777, 2.0).otherwise(1.0), "decay_rate": F.lit(0.1), "importance": F.lit(0.5)})
    got = maintain.consolidate(df, F.lit(NOW)).groupBy("cluster", "survivor", "action").count().collect()
    assert {tuple(r) for r in got} == {(0, 777, "keep", 1), (0, 777, "archive", 99_999)}


def test_batches_that_are_run_again(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python([{"id": k, "title": k, "summary": "s", "tags": [], "created_at": NOW, "last_accessed_at": NOW, "base_strength": 1.0, "decay_rate": 0.1, "importance": 0.5, "access_count": 0, "is_pinned": False, "is_archived": False} for k in "ab"])
    log = spark.createDataFrame([("a", NOW)], "id string, at timestamp")
    store.reinforce(log, once=("stream", 0))
    store.reinforce(log, once=("stream", 0))  # the batch again: it was committed
    assert store.get("a").first().access_count == 1
    store.reinforce(log, once=("stream", 1))
    store.reinforce(log, once=("other", 0))
    store.compact()
    store.reinforce(log, once=("stream", 1))  # the ledger outlives compaction
    assert store.get("a").first().access_count == 3
    log.write.parquet(str(tmp_path / "log"))
    accesses = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    reinforce_stream(accesses, store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert store.get("a").first().access_count == 4
    # the commit of the stream's own log is lost, so it runs its last batch again
    for f in list((tmp_path / "c" / "commits").iterdir()):
        f.unlink()
    reinforce_stream(accesses, store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert store.get("a").first().access_count == 4


def test_no_scratch_is_left(spark, tmp_path):
    """Storing and searching leave no intermediate tables behind but the verdicts that are still read."""
    engine = Engine(spark, str(tmp_path / "s"))
    made = len(scratch._made)
    for k in range(2):
        rows = spark.createDataFrame([(f"r{k}", "Ferry", f"boats on day {k}")], "id string, title string, summary string")
        verdicts = engine.store(rows, NOW)
        assert engine.search("ferry", NOW, reinforce=False)[0].title == "Ferry"
    assert verdicts.count() == 1 and len(scratch._made) - made == 2


def memory(key, **more):
    row = {"id": key, "title": key, "summary": "s", "tags": [], "created_at": NOW, "last_accessed_at": NOW, "base_strength": 1.0, "decay_rate": 0.1, "importance": 0.5, "access_count": 0, "is_pinned": False, "is_archived": False}
    return row | more


def test_reads_after_compaction(spark, tmp_path):
    """A base needs no comparison of versions; later commits replace and delete its rows; decay is a range over the stored days."""
    rng = random.Random(5)
    store = MemoryStore(spark, str(tmp_path / "s"))
    rows = [memory(f"m{i}", base_strength=rng.choice([0.05, 0.5, 1.0, 3.0]), importance=rng.random(), is_pinned=i % 9 == 0, decay_rate=rng.choice([0.0, 0.1, 0.2]), last_accessed_at=NOW - timedelta(days=rng.randrange(60))) for i in range(80)]
    store.save_python(rows)
    store.save_python([memory("m3", title="later")])
    store.compact()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(store.scan()) and "Exchange" not in plan(store.scan()) and store.scan().count() == 80
    assert "prune_day" in plan(store.scan().where(strength.below(0.1, F.lit(NOW), "prune_day"))).split("PushedFilters")[1]
    store.save_python([memory("m4", title="last"), memory("new")])
    store.delete(["m5"])
    now = {r.id: r.title for r in store.scan().collect()}
    assert len(now) == 80 and (now["m3"], now["m4"], now["new"]) == ("later", "last", "new") and "m5" not in now
    assert store.get("m4").first().title == "last" and store.get("m5").count() == 0
    assert {r.id: r.title for r in store.fetch(spark.createDataFrame([("m3",), ("m4",), ("m5",)], "id string")).collect()} == {"m3": "later", "m4": "last"}
    for days in (-40, 0, 13, 400):
        at = F.lit(NOW + timedelta(days=days))
        for threshold in (0.1, 0.3, 0.9):
            assert [r.id for r in store.weak(threshold, 100, at).collect()] == [r.id for r in weak(store.scan(), threshold, 100, at).collect()]
    want = {r.id for r in maintain.prune(store.scan(), F.lit(NOW)).collect()}
    store.prune(F.lit(NOW))
    assert {r.id for r in store.scan().collect()} == want and 0 < len(want) < 80


def test_leaders_of_very_many_near_copies(spark, monkeypatch):
    """As the clusters of all pairs, but few of the pairs of 300 near copies are looked at."""
    rng = random.Random(11)
    texts = []
    for base in ("".join(rng.choice("abcdefghij ") for _ in range(240)) for _ in range(3)):
        for _ in range(100):
            t = list(base)
            for _ in range(rng.choice([1, 2, 4, 6, 9])):
                t[rng.randrange(240)] = rng.choice("xyz")
            texts.append("".join(t))
    rng.shuffle(texts)
    df = rows_of(spark, texts).cache()
    plain = lambda rows: sorted((r.id, r.leader) for r in rows.collect())
    whole, seen = maintain.leader_clusters, []
    pairs = maintain.similar_pairs(df, 0.8)
    want = plain(whole(pairs))
    monkeypatch.setattr(maintain, "leader_clusters", lambda pairs: seen.append(pairs.count()) or whole(pairs))
    assert plain(maintain.similar_clusters(df, 0.8)) == want
    assert pairs.count() > 5000 and sum(seen) < 1000


def test_each_set_has_a_chance_to_meet(spark):
    """Sets at the very edge of the threshold, of all sizes, on both sides of each level."""
    from lorebase.operators.set_join import similar_sets

    rows, want = [], set()
    for i, n in enumerate([1, 2, 4, 5, 9, 10, 18, 20, 36, 40, 99, 100, 160, 200, 212, 250, 320, 400]):
        for t, cut in ((0, 0), (1, n // 5), (2, -(-n // 10))):  # whole; four fifths of it; a tenth exchanged
            items = [f"{i} {k}" for k in range(cut, n)] + ([f"{i} new {k}" for k in range(cut)] if t == 2 else [])
            rows.append((3 * i + t, items, len(items)))
    for i, (a, x, _) in enumerate(rows):
        for b, y, _ in rows[i + 1 :]:
            both = len(set(x) & set(y))
            want |= {(a, b, both)} if both >= 0.8 * (len(x) + len(y) - both) - 1e-6 else set()
    got = similar_sets(spark.createDataFrame(rows, "id long, items array<string>, n int"), 0.8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_copies_are_compared_in_blocks(spark, monkeypatch):
    """All pairs of 90 near copies and some others, of which few move their sets pair by pair."""
    from lorebase.operators import set_join

    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    sets = [{*rng.sample(base, 150 - rng.randrange(12)), *(f"v{rng.randrange(900)}" for _ in range(rng.randrange(6)))} for _ in range(90)]
    sets += [{f"o{i // 2} {k}" for k in range(40 - i % 2)} for i in range(10)]
    want = {(i, j, len(x & y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) >= 0.8 * len(x | y) - 1e-6}
    rows = spark.createDataFrame([(i, sorted(x), len(x)) for i, x in enumerate(sets)], "id long, items array<string>, n int")
    whole, moved = set_join.shared, []
    monkeypatch.setattr(set_join, "BLOCK", 20)
    monkeypatch.setattr(set_join, "shared", lambda pairs, *of: moved.append(pairs.count()) or whole(pairs, *of))
    got = set_join.similar_sets(rows, 0.8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 2000 and sum(moved) < 1000
