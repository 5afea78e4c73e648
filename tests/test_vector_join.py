"""The join of vectors by cells, and blended similarity on top of it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.operators import maintain, vector_join
from lorebase.operators.vector_join import near_vectors
from tests.test_engine import NOW

EVERY = lambda a, b: F.lit(True)
SCHEMA = "id long, embedding array<double>"


def brute(rows, least):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x and y and len(x) == len(y):
                u, v = np.array(x), np.array(y)
                n = np.linalg.norm(u) * np.linalg.norm(v)
                if n > 0 and u @ v / n >= least:
                    out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_are_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 12))
    rows = [(i, (centres[i % 9] + 0.35 * rng.normal(size=12)).tolist()) for i in range(220)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]  # one text many times: one cell
    rows += [(600, None), (601, []), (602, [0.0] * 12), (603, [1.0, 2.0]), (604, [2.0, 4.1]), (605, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (0.6, 0.9):
        got = [(r.a, r.b) for r in near_vectors(df, least, EVERY).collect()]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == brute(rows, least) and all(a < b for a, b in got)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], SCHEMA), 0.9, EVERY).count() == 0
    assert near_vectors(spark.createDataFrame([], SCHEMA), 0.9, EVERY).count() == 0
    with pytest.raises(ValueError):
        near_vectors(spark.createDataFrame([], SCHEMA), 0.0, EVERY)


def test_clusters_with_vectors(spark):
    """As the clusters of all blended pairs; rows with a zero vector are not like their copies."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(50)) for _ in range(4)]
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 0.0], None]
    rows = [(i, rng.choice(texts) + rng.choice(["", "", "zz"]), rng.choice(vectors), False) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, content_normalized string, embedding array<double>, is_archived boolean").cache()
    plain = lambda found: sorted((r.id, r.leader) for r in found.collect())
    assert plain(maintain.similar_clusters(df, 0.8, use_vectors=True)) == plain(maintain.leader_clusters(maintain.similar_pairs(df, 0.8, use_vectors=True)))


def test_very_many_equal_memories_with_vectors(spark):
    df = spark.range(50_000).select("id", F.lit("the same words again").alias("content_normalized"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"), F.lit(NOW).alias("last_accessed_at"))
    df = df.withColumns({"is_archived": F.lit(False), "is_pinned": F.lit(False), "base_strength": F.when(F.col("id") == 777, 2.0).otherwise(1.0), "decay_rate": F.lit(0.1), "importance": F.lit(0.5)})
    got = maintain.consolidate(df, F.lit(NOW), use_vectors=True).groupBy("cluster", "survivor", "action").count().collect()
    assert {tuple(r) for r in got} == {(0, 777, "keep", 1), (0, 777, "archive", 49_999)}


def test_blended_pairs_meet_by_vectors_alone(spark, monkeypatch):
    """At 0.8 no pair without near vectors is blended, so sets of rows with vectors are not joined at lower thresholds."""
    asked, whole = [], maintain.similar_sets
    monkeypatch.setattr(maintain, "similar_sets", lambda rows, threshold: asked.append(threshold) or whole(rows, threshold))
    rng = np.random.default_rng(6)
    text = "the quick brown fox jumps over the lazy dog by the river"
    x = rng.normal(size=(30, 8))
    rows = [(i, text[: 56 - i % 15], x[i // 2].tolist() if i % 5 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, content_normalized string, embedding array<double>")
    got = {(r.a, r.b) for r in maintain.similar_pairs(df, 0.8, use_vectors=True).collect()}
    grams = lambda t: {f"  {t.strip()}  "[i : i + 3] for i in range(len(t.strip()) + 2)}
    want = set()
    for a, s, u in rows:
        for b, t, v in rows[a + 1 :]:
            j = len(grams(s) & grams(t)) / len(grams(s) | grams(t))
            c = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)) if u and v else None
            want |= {(a, b)} if (j if c is None else 0.6 * c + 0.4 * j) >= 0.8 else set()
    assert asked == [0.8] and got == want and got


def test_products_take_turns(spark, monkeypatch):
    """The same pairs where one shuffle may send few rows, and where the test of further columns is in the products."""
    monkeypatch.setattr(vector_join, "BLOCK", 16)
    monkeypatch.setattr(vector_join, "SENT_AT_ONCE", 700)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 10))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=10)).tolist(), i % 4) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA + ", n long")
    want = brute([r[:2] for r in rows], 0.8)
    made, whole = [], vector_join.written
    monkeypatch.setattr(vector_join, "written", lambda df: made.append(df.columns) or whole(df))
    may = lambda one, p, other, q: one["n"].to_numpy()[p] == other["n"].to_numpy()[q]
    found = [(r.a, r.b) for r in near_vectors(df, 0.8).collect()]
    assert set(found) == want and len(found) == len(want) and made.count(["x", "y"]) > 1
    found = [(r.a, r.b) for r in near_vectors(df, 0.8, may=may).collect()]
    assert set(found) == {(a, b) for a, b in want if a % 4 == b % 4} and len(found) == len(set(found)) > 0
