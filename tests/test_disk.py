"""What the similarity queries leave on disk, and that they find the same where little may be moved at once."""

import random

from pyspark.sql import functions as F

from lorebase.operators import maintain, set_join
from lorebase.plans import scratch
from lorebase.plans.memory_view import memories
from tests.test_chains import rows_of

DIR = "/root/testdata/sf0.001"


def shuffled(spark):
    """Shuffle files that there are now."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def near_copies(n, seed=21):
    rng = random.Random(seed)
    texts = []
    for base in ("".join(rng.choice("abcdefghij é𝛼") for _ in range(120)) for _ in range(5)):
        for _ in range(n // 5):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                t[rng.randrange(120)] = rng.choice("xyz😀😁")
            texts.append("".join(t))
    rng.shuffle(texts)
    return texts


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    out = scratch.written(spark.range(20_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("k")).count())
    assert out.count() <= 5000 and shuffled(spark) <= before + 8  # those of the count itself


def test_sets_meet_in_turns(spark, monkeypatch):
    """All pairs, with turns of few keys and shares of few pairs, and with no intermediate tables left."""
    texts = near_copies(150)
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    sets = [(i, sorted(g), len(g)) for i, g in enumerate(dict.fromkeys(map(frozenset, grams)))]
    want = {(a, b, len({*x} & {*y})) for i, (a, x, _) in enumerate(sets) for b, y, _ in sets[i + 1 :] if len({*x} & {*y}) >= 0.8 * len({*x} | {*y}) - 1e-6}
    rows = spark.createDataFrame(sets, "id long, items array<string>, n int")
    monkeypatch.setattr(set_join, "KEYS_AT_ONCE", 3000)
    monkeypatch.setattr(set_join, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(set_join, "LARGE", 40)
    monkeypatch.setattr(set_join, "FREQUENT", 50)
    before = len(scratch._made)
    found = set_join.similar_sets(rows, 0.8).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 200
    assert len(scratch._made) - before <= 2


def test_leaders_leave_one_table(spark, monkeypatch):
    monkeypatch.setattr(set_join, "KEYS_AT_ONCE", 3000)
    monkeypatch.setattr(set_join, "PAIRS_AT_ONCE", 100)
    df = rows_of(spark, near_copies(150)).cache()
    want = sorted(tuple(r) for r in maintain.leader_clusters(maintain.similar_pairs(df, 0.8)).collect())
    before = len(scratch._made)
    found = maintain.similar_clusters(df, 0.8)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100
    assert len(scratch._made) - before <= 1


def test_memories_are_joined_without_whole_texts(spark):
    """Texts are not shuffled where only what is indexed of them is read."""
    plan = memories(spark, DIR).select("id", "content_normalized")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert joins and any("text#" in line for line in plan[joins[-1] :]) and not [line for line in plan[: joins[-1] + 1] if "text#" in line]
