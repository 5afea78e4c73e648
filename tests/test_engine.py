"""The store, search and maintenance, after the expectations in FIXTURES.md."""

import glob
import hashlib
import math
import random
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lorebase.api import Engine
from lorebase.config import EngineConfig
from lorebase.functions import strength, text, vector
from lorebase.operators import maintain
from lorebase.operators.embed import HashedTrigramEmbedder, mean_pooled, select_embedder
from lorebase.operators.schedule import MaintenanceLoop
from lorebase.operators.search import Probe, batch_search, candidates, search, text_search
from lorebase.sources.gram_index import GramIndex
from lorebase.sources.store import MemoryStore
from lorebase.streaming.ingest import access_counts, reinforce_stream, store_stream

NOW = datetime(2024, 2, 1)


def py_trigrams(s):
    s = s.strip().lower()
    p = f"  {s}  "
    return {p[i : i + 3] for i in range(len(p) - 2) if p[i : i + 3].strip()} if s else set()


def test_trigrams_and_jaccard(spark):
    texts = ["", "   ", "br", "Ø#", "a\n\n\nb", "Stone Bridge Toll", " tab\there "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.trigrams(F.col("t")).alias("g"), text.jaccard(text.trigrams(F.col("t")), text.trigrams(F.lit("bridge"))).alias("j"))
    for r in rows.collect():
        assert set(r.g) == py_trigrams(r.t) and len(r.g) == len(set(r.g))
        a, b = py_trigrams(r.t), py_trigrams("bridge")
        assert r.j == pytest.approx(len(a & b) / len(a | b) if a else 0, abs=1e-7)


def test_trigrams_of_long_texts_take_linear_time(spark):
    words = ["stone", "Bridge", "\U0001f680", "ß\u00a0\u2003 x", "toll\n\n\n", "a" * 7]
    rng = random.Random(3)
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(60_000))
    start = time.time()
    got = spark.createDataFrame([(long,)], "t string").select(text.trigrams(F.col("t")).alias("g")).first().g
    assert time.time() - start < 20  # by the square of its length, a text like this takes minutes
    assert set(got) == py_trigrams(long) and len(got) == len(set(got))


def test_embedding_text_reads_long_words_once_and_long_texts_in_part(spark):
    head = "  Mail a.b@c.de!!! or www.x.yz,,  then\tmore  "
    texts = ["w" * 400_000, head + "é x" * 3000, "y" * 3000 + " " + head, head * 200]
    start = time.time()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.embedding_text(F.col("t"))).collect()]
    assert time.time() - start < 20  # tried from each letter, the long word takes minutes
    once = "Mail [EMAIL] ! or [URL] then more"
    assert got == ["w" * 1024, (once + " " + " ".join(["x"] * 3000))[:1024], "y" * 1024, " ".join([once] * 200)[:1024]]


def counted(rows, spark, column):
    """``rows`` with a column that passes through Python, and how many of its values did."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return rows.withColumn(column, F.udf(look, rows.schema[column].dataType)(column)), seen


def test_index_computes_its_memories_once(spark, tmp_path):
    rows, seen = counted(many(spark, 40, F.lit("stone bridge")), spark, "trigrams")
    GramIndex.write(rows, str(tmp_path / "index"))
    assert seen.value == 40


def test_batch_search_computes_its_memories_once(spark):
    rows, seen = counted(many(spark, 40, F.lit("stone bridge")).withColumn("embedding", F.lit(None).cast("array<float>")), spark, "trigrams")
    queries = spark.createDataFrame([(1, "stone")], "query_id int, query string").withColumn("query_vector", F.lit(None).cast("array<float>"))
    assert batch_search(rows, queries, 4, F.lit(NOW)).count() == 4
    assert seen.value == 40


def test_compaction_shuffles_and_writes_once(spark, tmp_path, monkeypatch):
    from lorebase.sources import store as module

    store, seen = MemoryStore(spark, str(tmp_path)), []
    store.save(many(spark, 40, F.lit("stone bridge")))
    store.save(many(spark, 10, F.lit("mill")))
    want = {r.id: (r.title, sorted(r.trigrams), r.content_normalized) for r in store.scan().collect()}
    monkeypatch.setattr(module, "written", lambda df: seen.append(df) or df)
    assert store.compact()["success"] and not seen
    assert {r.id: (r.title, sorted(r.trigrams), r.content_normalized) for r in store.scan().collect()} == want and len(want) == 40


def test_surrogates():
    assert text.without_orphans("ok 🚀 \ud83d x \ude00") == "ok 🚀  x "


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(vector.cosine(a, b), vector.normalized_cosine(a, b), vector.euclidean(a, b), vector.l2_normalized(a)).collect()
    assert [round(r[0], 9) for r in got] == [0, 1, 0, 0, 0]
    assert [round(r[1], 9) for r in got] == [0.5, 1, 0.5, 0.5, 0.5]
    assert got[3][2] == vector.FAR and got[3][3] == [] and got[2][3] == [0, 0]


def test_strength(spark):
    row = spark.createDataFrame([(1.0, 0.1, 0.5, NOW - timedelta(days=10), False), (1.0, 0.1, 0.5, NOW - timedelta(days=100), True)], "base_strength double, decay_rate double, importance double, last_accessed_at timestamp, is_pinned boolean")
    got = [r[0] for r in row.select(strength.current_strength(F.lit(NOW))).collect()]
    assert got == [pytest.approx(math.exp(-0.75)), 1.0]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), EngineConfig())


def test_store_search_and_history(spark, engine):
    rows = [("1", "Kiln temperatures", "glaze by glaze", ["ledger", "clay"], [1.0, 0.0]), ("2", "Wheel", "centring a lump", ["clay"], [0.0, 1.0]), ("3", "Tides", "moon and sea", [], None)]
    df = spark.createDataFrame(rows, "id string, title string, summary string, tags array<string>, embedding array<float>")
    assert {r.action for r in engine.store(df, NOW).collect()} == {"StoredNew"}
    assert [r.id for r in engine.search("kiln temper", NOW, reinforce=False)][0] == "1"
    assert engine.search("   ", NOW) == []
    all_rows = engine.store_.scan()
    # three trigrams are shared: kept by the trigram rule, not by the substring rule
    assert [r.id for r in text_search(all_rows.where("id = '3'"), "moonshot", 5, F.lit(NOW)).collect()] == ["3"]
    assert text_search(all_rows, "moonshot", 5, F.lit(NOW), EngineConfig(candidate_mode="substring_or_tag")).count() == 0
    assert {r.id for r in search(all_rows, "clay", 5, F.lit(NOW), tags=["CLAY"]).collect()} == {"1", "2"}
    assert engine.get("1", NOW).access_count == 0 and engine.get("1", NOW, reinforce=False).access_count == 1
    engine.update(spark.createDataFrame([("2", "Coil building")], "id string, title string"))
    assert engine.get("2", NOW, reinforce=False).title == "Coil building"
    assert engine.tag_history("LEDGER", NOW).first().status == "CURRENT"
    assert engine.delete(["3", "none"]) == 1 and engine.get("3", NOW) is None
    with pytest.raises(ValueError):
        engine.store(spark.createDataFrame([("", "x")], "title string, summary string"), NOW)


def test_compact_and_stats(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    assert store.scan().count() == 0
    rows = spark.range(20).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Memory "), "id").alias("title"), F.lit("s").alias("summary"), F.array(F.lit("bulk")).alias("tags"),
        F.lit(NOW).alias("created_at"), F.lit(NOW).alias("last_accessed_at"), F.lit(1.0).alias("base_strength"), F.lit(0.1).alias("decay_rate"), F.lit(0.5).alias("importance"),
        F.lit(0).alias("access_count"), F.lit(False).alias("is_pinned"), F.lit(False).alias("is_archived"))
    store.save(rows)
    store.save(rows)
    done = store.compact()
    assert done["success"] and 0 < done["after"] < done["before"] and store.scan().count() == 20
    assert store.stats(F.lit(NOW)).first().total == 20
    held = threading.Event()
    free = threading.Event()
    other = threading.Thread(target=lambda: store._lock.acquire() and (held.set(), free.wait(60), store._lock.release()))
    other.start()
    held.wait(60)
    assert store.compact()["success"] is False
    free.set()
    other.join()
    assert {"compact"} == set(store.status()["last_run"]) and store.status()["running"] is False
    assert store.prune(F.lit(NOW + timedelta(days=365)))["pruned"] == 20 and store.scan().count() == 0


def test_leaders_are_not_transitive(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r.id: r.leader for r in maintain.leader_clusters(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 5: 5, 6: 5}


def one(spark, key, title="t", **more):
    row = {"id": key, "title": title, "summary": "s", "content": "", "tags": [], "created_at": NOW, "last_accessed_at": NOW, "base_strength": 1.0, "decay_rate": 0.1, "importance": 0.5,
           "access_count": 0, "is_pinned": False, "is_archived": False, "valid_from": NOW, "superseded_ids": [], "linked_ids": [], **more}
    return [row]


def together(*works):
    failed = []

    def run(w):
        try:
            w()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(w,)) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == []


def test_concurrent_saves_and_readers(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    together(*[lambda i=i: store.save_python(one(spark, str(i))) for i in range(20)])
    assert store.scan().count() == 20
    counts = []
    readers = [lambda: [counts.append(store.scan().count()) for _ in range(3)] for _ in range(5)]
    writers = [lambda i=i: store.save_python(one(spark, f"w{i}")) for i in range(5)]
    together(*readers, *writers, store.compact)
    assert all(20 <= n <= 25 for n in counts) and store.scan().count() == 25


def test_writers_of_two_processes_lose_nothing(spark, tmp_path):
    a, b = MemoryStore(spark, str(tmp_path / "s")), MemoryStore(spark, str(tmp_path / "s"))  # two locks
    a.save_python(one(spark, "x"))
    log = spark.createDataFrame([("x", NOW)], "id string, at timestamp")
    together(*[lambda s=s: s.reinforce(log) for s in (a, b, a, b)])
    assert a.get("x").first().access_count == 4


def test_a_crash_leaves_the_last_state(spark, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "x", "first"))

    def crash(manifest):
        raise RuntimeError("power cut")

    monkeypatch.setattr(store, "_publish", crash)  # the rows are written, the manifest is not
    with pytest.raises(RuntimeError):
        store.save_python(one(spark, "x", "second"))
    (tmp_path / "s" / "manifest-000000000002.json").write_text('{"version": 2, "com')  # cut off
    again = MemoryStore(spark, str(tmp_path / "s"))
    assert again.get("x").first().title == "first"
    lazy = again.scan()
    monkeypatch.undo()
    again.vacuum(grace=1e9)
    (tmp_path / "s" / "manifest-000000000002.json").unlink()
    again.save_python(one(spark, "x", "third"))
    assert again.compact()["success"] and again.get("x").first().title == "third"
    assert lazy.first().title == "first"  # within the grace
    assert again.vacuum(grace=-1) > 0 and again.get("x").first().title == "third"
    again.close()
    with pytest.raises(ValueError):
        again.save_python(one(spark, "y"))


def test_surrogates_in_the_write_path(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "x", "ok \ud83d here", content="🚀 \ude00", tags=["a\ud83d"]))
    row = store.get("x").first()
    assert (row.title, row.content, row.tags) == ("ok  here", "🚀 ", ["a"])


def angle(cosine):
    return [cosine, math.sqrt(1 - cosine * cosine)]


def vectors(sem):
    """A unit vector whose normalised cosine with [1, 0] is ``sem``."""
    return angle(2 * sem - 1)


FIELDS = "id string, title string, summary string, content string, tags array<string>, embedding array<float>, query_vector array<float>"


def put(engine, *rows, days=0):
    df = engine.spark.createDataFrame([(*r, r[-1]) if len(r) == 6 else r for r in rows], FIELDS)
    return {r.id: r for r in engine.store(df, NOW + timedelta(days=days)).collect()}


def test_conflict_verdicts(spark, engine):
    tags = ["harbour", "staff"]
    assert put(engine, ("a", "Night watch", "Ines keeps the log", "on paper", tags, [1.0, 0.0]))["a"].action == "StoredNew"
    # between 0.8 and 0.95: supersedes
    v = put(engine, ("b", "Night watch", "Ines and Tom keep the log", "on paper still", tags, vectors(0.9)), days=1)["b"]
    assert (v.action, v.superseded) == ("StoredWithSupersede", ["a"])
    a, b = engine.get("a", NOW, reinforce=False), engine.get("b", NOW, reinforce=False)
    assert a.is_archived and a.superseded_by == "b" and a.valid_until == NOW + timedelta(days=1) and b.superseded_ids == ["a"] and not b.is_archived
    # the old one was a hit of the search, so it was reinforced before it was archived
    assert a.access_count == 1 and a.base_strength == pytest.approx(1.1)
    history = {r.id: r.status for r in engine.tag_history("HARBOUR", NOW + timedelta(days=1)).collect()}
    assert history == {"a": "Superseded", "b": "CURRENT"}
    assert [r.id for r in engine.tag_history("harbour", NOW, include_archived=False).collect()] == ["b"]


def test_conflict_duplicate(spark, engine):
    put(engine, ("a", "Ferry", "Boats leave on the hour", "since May", [], [1.0, 0.0]))
    v = put(engine, ("b", "Ferry", "Boats leave on the hour", "since May, with four boats and two crews", [], vectors(0.99)))["b"]
    assert (v.action, v.target) == ("ReinforcedExisting", "a") and engine.get("b", NOW) is None
    a = engine.get("a", NOW, reinforce=False)
    # once as a hit and once as a duplicate, and the longer content stays
    assert a.access_count == 2 and a.base_strength == pytest.approx(1 + 0.1 + 0.1 / math.sqrt(2)) and "crews" in a.content
    shorter = put(engine, ("c", "Ferry", "Boats leave on the hour", "x", [], [1.0, 0.0]))["c"]
    assert shorter.target == "a" and "crews" in engine.get("a", NOW, reinforce=False).content


def test_conflict_coexist_and_new(spark, engine):
    put(engine, ("a", "Knots for ropes", "bowline and hitch", "", [], [1.0, 0.0]))
    assert put(engine, ("b", "Ropes", "splices", "", [], vectors(0.7)))["b"].action == "StoredCoexist"
    assert put(engine, ("c", "Oars", "no ropes on board", "", [], [-1.0, 0.0]))["c"].action == "StoredNew"
    assert not any(engine.get(k, NOW, reinforce=False).is_archived for k in "abc")


def test_conflict_chain_and_batch(spark, engine):
    put(engine, ("1", "Bridge toll", "The toll is two crowns", "", [], [1.0, 0.0]))
    # two rows of one batch would supersede the same memory: the lower id does, and the other is a duplicate of it
    v = put(engine, ("2", "Bridge toll", "The toll is three crowns", "", [], vectors(0.9)), ("3", "Bridge toll", "The toll is four crowns", "", [], vectors(0.85)))
    assert (v["2"].action, v["2"].superseded, v["3"].action, v["3"].target) == ("StoredWithSupersede", ["1"], "ReinforcedExisting", "2")
    current = {r.id for r in engine.store_.scan().where("not is_archived").collect()}
    assert current == {"2"}


def test_a_batch_is_stored_as_one_by_one(spark, tmp_path):
    """A row that supersedes, one that is then a duplicate of it, a copy of that, and one that is related to all."""
    old = [("o1", "Mill race", "The gate is shut", "kept", ["water"], [1.0, 0.0])]
    new = [("r1", "Mill race", "The gate is open", "seen", [], vectors(0.9)), ("r2", "Mill race", "The gate is open now", "seen twice", [], vectors(0.91)), ("r3", "Mill race", "The gate is open now", "seen", [], vectors(0.91)), ("r4", "Eel trap", "Near the gate", "", ["water"], vectors(0.3))]

    def state(e):
        rows = e.store_.scan().collect()
        return {r.id: (r.access_count, round(r.base_strength, 9), r.is_archived, r.superseded_by, r.content, r.superseded_ids) for r in rows}

    cfg = EngineConfig(batch_order=0.0)
    one, whole = Engine(spark, str(tmp_path / "one"), cfg), Engine(spark, str(tmp_path / "whole"), cfg)
    full = [(*r, r[-1]) for r in old]
    for e in (one, whole):
        e.store_unlimited(spark.createDataFrame(full, FIELDS), NOW)
    single = {}
    for r in new:
        single |= put(one, r)
    batch = put(whole, *new)
    plain = lambda v: {k: (x.action, x.target, x.superseded) for k, x in v.items()}
    assert plain(batch) == plain(single) and state(whole) == state(one)
    assert {x.action for x in batch.values()} == {"StoredWithSupersede", "ReinforcedExisting", "StoredCoexist"}


def test_copies_of_a_batch_settle_together(spark, engine):
    rows = [(f"{i:03}", "Weir", "Sluice times", "x", [], [1.0, 0.0]) for i in range(60)]
    v = put(engine, *rows)
    assert v["000"].action == "StoredNew" and {(x.action, x.target) for k, x in v.items() if k != "000"} == {("ReinforcedExisting", "000")}
    assert [r.id for r in engine.store_.scan().collect()] == ["000"] and engine.get("000", NOW, reinforce=False).access_count == 118
    assert len(engine.store_._manifest()["commits"]) == 2


def test_query_vector_is_of_title_and_summary(spark, engine):
    put(engine, ("a", "Choir", "Sings on feast days", "five voices", [], [1.0, 0.0], [1.0, 0.0]))
    # by its stored vector it would be a duplicate, by its query vector it is unrelated
    v = put(engine, ("b", "Choir", "Sings on feast days", "eight", [], [1.0, 0.0], [-1.0, 0.0]))["b"]
    assert v.action == "StoredNew"


def test_embedder_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), EngineConfig(), HashedTrigramEmbedder(64))
    rows = spark.createDataFrame([("a", "Lighthouse Keeper Manual", "lamps and lenses", "")], "id string, title string, summary string, content string")
    assert e.store(rows, NOW).first().action == "StoredNew"
    again = e.store(rows.withColumn("id", F.lit("b")), NOW).first()
    assert (again.action, again.target) == ("ReinforcedExisting", "a")
    assert e.search("lighthouse manual", NOW, reinforce=False)[0].semantic_score > 0.5


def test_required_fields_and_unlimited(spark, engine):
    with pytest.raises(ValueError):
        engine.store(spark.createDataFrame([("\t ", "x")], "title string, summary string"), NOW)
    long = "x" * 3000
    engine.store_unlimited(spark.createDataFrame([("p", long, "")], "id string, title string, summary string"), NOW)
    assert len(engine.get("p", NOW, reinforce=False).title) == 3000


def test_stats_report(spark, engine):
    empty = engine.stats_report(NOW)
    assert (empty["total"], empty["oldest"], empty["newest"], empty["average_strength"], empty["size"]) == ("0", "N/A", "N/A", "0.00", "0.00 MB")
    put(engine, ("a", "t", "s", "", [], None))
    got = engine.stats_report(NOW)
    assert (got["total"], got["oldest"], got["average_strength"]) == ("1", "2024-02-01 00:00:00", "1.00") and got["size"] != "0.00 MB"


def test_codec_and_selection(spark, tmp_path):
    rows = spark.createDataFrame([([1.0, -2.5],), (None,), ([],)], "v array<float>").select("v", vector.to_bytes(F.col("v")).alias("b"))
    got = rows.select("v", "b", vector.from_bytes(F.col("b")).alias("w")).collect()
    assert [r.w for r in got] == [[1.0, -2.5], None, []] and bytes(got[0].b) == b"\x00\x00\x80\x3f\x00\x00\x20\xc0"
    assert not select_embedder().available and not select_embedder("none.onnx", "none.json").available
    assert select_embedder(fallback=HashedTrigramEmbedder(8)).dimensions == 8
    for f in ("m.onnx", "t.json"):
        (tmp_path / f).write_text("x")
    assert select_embedder(str(tmp_path / "m.onnx"), str(tmp_path / "t.json")).available
    assert not select_embedder(str(tmp_path / "m.onnx"), str(tmp_path / "t.json"), enabled=False).available


def test_maintenance_loop(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "old", last_accessed_at=NOW - timedelta(days=300)) + one(spark, "new"))
    loop = MaintenanceLoop(store, decay_every=3600, consolidate_every=None, first_after=0, now=lambda: NOW)
    loop.start()
    for _ in range(600):
        if loop.done["prune"]:
            break
        time.sleep(0.1)
    loop.stop()
    assert loop.done["prune"][0]["pruned"] == 1 and loop.done["consolidate"] == [] and [r.id for r in store.scan().collect()] == ["new"]
    assert "prune" in store.status()["last_run"]


def brute_pairs(rows, threshold, use_vectors):
    out = {}
    for i, (a, s, x) in enumerate(rows):
        for b, t, y in rows[i + 1 :]:
            g, h = py_trigrams(s), py_trigrams(t)
            j = len(g & h) / len(g | h) if g and h else 0
            if use_vectors and x and y:
                j = 0.6 * sum(p * q for p, q in zip(x, y)) + 0.4 * j
            if g and h and j >= threshold - 1e-7:
                out[a, b] = j
    return out


def test_similar_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.choice([4, 9, 30, 120, 300]))).strip() + "z" for _ in range(12)]
    rows = []
    for i in range(120):
        s = list(base[i % 12])
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice("abcdef")
        rows.append((i, "".join(s), angle(rng.uniform(-1, 1)) if i % 3 else None))
    rows += [(200, "", [1.0, 0.0]), (201, "", None), (202, "  ", None)]
    df = spark.createDataFrame(rows, "id long, content_normalized string, embedding array<double>")
    for threshold, use in ((0.8, False), (0.7, False), (0.8, True), (0.95, True), (0.55, True)):
        got = {(r.a, r.b): r.similarity for r in maintain.similar_pairs(df, threshold, use_vectors=use).collect()} if threshold >= 0.65 else None
        want = brute_pairs([(a, s.strip(), x) for a, s, x in rows], threshold, use)
        if got is None:
            with pytest.raises(ValueError):  # rows without vectors need parts that select
                maintain.similar_pairs(df, threshold, use_vectors=use)
            continue
        assert set(got) == set(want), (threshold, use)
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_long_chain_of_leaders(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(24)], "a long, b long")
    got = {r.id: r.leader for r in maintain.leader_clusters(pairs).collect()}
    assert got == {i: i - i % 2 for i in range(25)}
    assert maintain.leader_clusters(pairs.where("false")).count() == 0


def test_consolidation_applies(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    text_ = "The quick brown fox jumps over the lazy dog"
    store.save_python(one(spark, "a", text_) + one(spark, "b", text_, base_strength=2.0) + one(spark, "c", "Something quite different here") + one(spark, "d", text_, is_archived=True))
    done = store.consolidate(F.lit(NOW))
    assert done == {"success": True, "merged": 1, "archived": 1}
    rows = {r.id: r for r in store.scan().collect()}
    assert rows["a"].is_archived and rows["a"].superseded_by == "b" and rows["a"].valid_until is None
    assert rows["b"].access_count == 1 and rows["b"].base_strength == pytest.approx(2.1) and not rows["b"].is_archived
    assert not rows["c"].is_archived and rows["d"].superseded_by is None
    assert store.reindex()["memories"] == 4 and set(store.status()["last_run"]) == {"consolidate", "reindex"}


def test_size_is_that_of_the_files(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    assert store.size_bytes() == 0
    store.save_python(one(spark, "a") + one(spark, "b"))
    store.save_python(one(spark, "b", "again"))
    files = lambda: sum(f.stat().st_size for f in (tmp_path / "s").glob("commit-*/*") if not f.name.startswith("."))
    assert store.size_bytes() == files() > 0
    done = store.compact()
    assert done["saved_percent"] == pytest.approx((1 - done["after"] / done["before"]) * 100)
    store.vacuum(grace=-1)
    assert store.size_bytes() == files() == done["after"]


def test_index_follows_the_state(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "a", "Copper Kettle", tags=["tin"]) + one(spark, "b", "Tea", tags=["copper"]))
    first = store.index()
    assert {r.id for r in first.probe("copper").collect()} == {"a", "b"} and store.index().paths == first.paths
    got = first.text_search(store.scan(), "copper kett", 5, F.lit(NOW)).collect()
    want = text_search(store.scan(), "copper kett", 5, F.lit(NOW)).collect()
    assert [(r.id, r._text_score) for r in got] == [(r.id, r._text_score) for r in want] != []
    store.delete(["a"])
    assert {r.id for r in store.index().probe("copper").collect()} == {"b"}
    for query in ("co", "e", "", "tea copper"):
        got = store.index().text_search(store.scan(), query, 5, F.lit(NOW)).collect()
        assert [(r.id, r._text_score) for r in got] == [(r.id, r._text_score) for r in text_search(store.scan(), query, 5, F.lit(NOW)).collect()], query


def many(spark, n, text_of):
    """Memories with what stage one reads, their texts by an expression over id."""
    rows = spark.range(n).select("id", text_of.alias("content_normalized"), F.array(F.concat(F.lit("tag"), F.col("id") % 7)).alias("tags"), F.lit(NOW).alias("last_accessed_at"))
    rows = rows.withColumns({"trigrams": text.trigrams(F.col("content_normalized")), "title": F.col("content_normalized"), "importance": F.lit(0.5), "decay_rate": F.lit(0.1), "is_pinned": F.col("id") % 50 == 0})
    return rows.withColumn("base_strength", 1 + (F.col("id") % 13) / 10).withColumn("is_archived", F.lit(False)).withColumn("valid_until", F.lit(None).cast("timestamp"))


def test_index_reads_little(spark, tmp_path):
    """Equal to the scan; few row groups of the postings can hold the query's grams, and few memories are fetched."""
    rows = many(spark, 4000, F.concat(F.lit("m "), F.md5(F.col("id").cast("string")), F.lit(" tag"), F.col("id") % 7)).cache()
    spark.conf.set("parquet.block.size", 1 << 16)
    try:
        index = GramIndex.write(rows, str(tmp_path / "i"))
    finally:
        spark.conf.unset("parquet.block.size")
    query = hashlib.md5(b"4711").hexdigest()[:9] + " " + hashlib.md5(b"17").hexdigest()
    fetched = []

    def fetch(found):
        fetched.append(found.select("id").distinct().count())
        return rows.join(found, "id")

    got = index.best(fetch, query, 5, F.lit(NOW)).orderBy(F.desc("_text_score"), "id").collect()
    want = text_search(rows, query, 5, F.lit(NOW)).collect()
    assert [(r.id, r._text_score) for r in got] == [(r.id, r._text_score) for r in want] and want[0].id == 17
    assert sum(fetched) < 1000
    grams, groups, read = set(index._query(query)[1]), 0, 0
    for f in glob.glob(str(tmp_path / "i" / "grams" / "*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            st = meta.row_group(g).column(0).statistics
            groups, read = groups + 1, read + any(st.min <= x <= st.max for x in grams)
    assert groups > 20 and read < groups / 2
    assert index.probe(query).orderBy(F.desc("fuzzy")).first().id == 17


def test_index_parts(spark, tmp_path):
    """Each commit brings its part; what later commits replace does not count, and compaction leaves one part."""
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "a", "Red harbour", tags=["boats"]) + one(spark, "b", "Blue harbour") + one(spark, "c", "Green mill"))
    parts = len(store.index().paths)
    store.save_python(one(spark, "b", "Yellow mill"))
    store.reinforce(spark.createDataFrame([("c", NOW)], "id string, at timestamp"))
    store.delete(["a"])
    assert parts == 1 and len(store.index().paths) == 4
    for query in ("harbour", "mill", "boats", "yellow mill", "mi"):
        scan = search(store.scan(), query, 3, F.lit(NOW)).collect()
        assert [(r.id, r.score) for r in store.search(query, 3, F.lit(NOW)).collect()] == [(r.id, r.score) for r in scan], query
    store.compact()
    assert len(store.index().paths) == 1 and store.search("mill", 3, F.lit(NOW)).count() == 2


@pytest.mark.parametrize("mode", ["trigram", "substring_or_tag"])
def test_batch_search_is_the_scan(spark, mode):
    """Many queries of many kinds over postings, against one scan each."""
    cfg = EngineConfig(candidate_mode=mode)
    names = F.array(*[F.lit(w) for w in ("harbour", "mill", "stone", "river", "a", "ox", "lantern")])
    word = lambda k: F.get(names, (F.col("id") * k % 7).cast("int"))
    rows = many(spark, 400, F.concat_ws(" ", word(3), word(5), F.concat(F.lit("n"), F.col("id")), word(11))).withColumn("embedding", F.lit(None).cast("array<float>")).cache()
    asked = ["harbour mill", "ston", "tag3 river", "ox", "q", "lantern lantern tag", "n3 n33 n333", "", "\t\t\tx"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string").withColumn("query_vector", F.lit(None).cast("array<float>"))
    got: dict = {}
    for r in batch_search(rows, queries, 4, F.lit(NOW + timedelta(days=9)), cfg).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 12)))
    for k, query in enumerate(asked):
        want = [(r.id, round(r.score, 12)) for r in search(rows, query, 4, F.lit(NOW + timedelta(days=9)), cfg=cfg).collect()]
        assert got.get(k, []) == want, query


def test_streams(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "s"))
    store.save_python(one(spark, "a") + one(spark, "b"))
    late = [("a", NOW), ("a", NOW + timedelta(hours=1)), ("b", NOW + timedelta(days=1))]
    spark.createDataFrame(late, "id string, at timestamp").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("id string, at timestamp").parquet(str(tmp_path / "log"))
    reinforce_stream(log, store, str(tmp_path / "c1"), availableNow=True).awaitTermination()
    assert {r.id: r.access_count for r in store.scan().collect()} == {"a": 2, "b": 1}
    reinforce_stream(log, store, str(tmp_path / "c1"), availableNow=True).awaitTermination()  # nothing new
    assert store.get("a").first().access_count == 2
    access_counts(log).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    batch = access_counts(spark.read.parquet(str(tmp_path / "log")))
    assert sorted((r.id, r.n) for r in batch.collect()) == [("a", 2), ("b", 1)]
    new = spark.createDataFrame([("c", "title", "s")], "id string, title string, summary string")
    new.write.parquet(str(tmp_path / "new"))
    arriving = spark.readStream.schema(new.schema).parquet(str(tmp_path / "new"))
    store_stream(arriving, store, str(tmp_path / "c2"), availableNow=True).awaitTermination()
    assert store.get("c").first().content_normalized == "title s"


def test_reports_and_opening(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "e"), '{"prune_threshold": 0.2, "candidate_mode": "trigram"}')
    assert e.cfg.prune_threshold == 0.2 and not e.embedder.available and e.health(NOW)["status"] == "healthy"
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path / "e"), '{"unknown": 1}')
    put(e, ("a", "Copper Guide", "all of it", "text", ["code", "work"], None))
    hit = e.search_report("copper", NOW)[0]
    assert hit.asDict() == {"title": "Copper Guide", "score": hit.score, "id": "a", "summary": "all of it", "tags": "code, work"} and len(hit.score.split(".")[1]) == 2
    got = e.detail_report("a", NOW)
    assert (got.created, got.strength, got.content) == ("2024-02-01 00:00:00", "1.10", "text")  # once by the search
    assert e.get("a", NOW, reinforce=False).access_count == 2 and e.detail_report("none", NOW) is None and e.search_report("  ", NOW) == []


def test_mean_pooling():
    hidden = np.array([[[3.0, 0.0], [1.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]])
    got = mean_pooled(hidden, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(got, [[2 / math.sqrt(8), 2 / math.sqrt(8)], [0, 0]])


def test_search_edges(spark, tmp_path):
    """The hand-made rows of the fixtures: short and repeated words, tags, a title alone, the future, archived rows that use up candidates."""
    store = MemoryStore(spark, str(tmp_path / "s"))
    rows = one(spark, "t", "Zebra title", tags=["Work"]) + one(spark, "f", "from the future", last_accessed_at=NOW + timedelta(days=10)) + one(spark, "y", "a year old", last_accessed_at=NOW - timedelta(days=365))
    rows += one(spark, "e", "empty tag", tags=[""]) + [r for i in range(4) for r in one(spark, f"z{i}", f"archived zebra {i}", is_archived=True, base_strength=5.0)]
    store.save_python(rows)
    df, now = store.scan(), F.lit(NOW)
    assert search(df, "zebra", 1, now).count() == 0  # three archived ones fill the candidates
    assert [r.id for r in search(df, "zebra", 2, now).collect()] == ["t"]
    assert [r.id for r in search(df, "work work", 5, now).collect()][0] == "t" and [r.id for r in search(df, "WORK", 5, now).collect()][0] == "t"
    got = {r.id: r for r in search(df, "the future year old title", 10, now).collect()}
    assert got["f"].recency_score > 1 and got["y"].recency_score == 0
    # an empty tag is contained in every query
    assert {r.id for r in candidates(df, Probe.literal(spark, "qqq"), 3, EngineConfig(candidate_mode="substring_or_tag")).collect()} == {"e"}
    queries = spark.createDataFrame([("1", "zebra", None), ("2", "z", None), ("3", "  ", None)], "query_id string, query string, query_vector array<double>")
    for cfg in (EngineConfig(), EngineConfig(candidate_mode="substring_or_tag")):
        batch = {}
        for r in batch_search(df, queries, 3, now, cfg).collect():
            batch.setdefault(r.query_id, []).append((r["rank"], r.id))
        for q, text_ in (("1", "zebra"), ("2", "z"), ("3", "  ")):
            assert [i for _, i in sorted(batch.get(q, []))] == [r.id for r in search(df, text_, 3, now, cfg=cfg).collect()], (q, cfg.candidate_mode)
