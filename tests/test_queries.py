"""Every core query against its SQL on a small scale factor."""

import math
import os

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from lorebase.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels events benchmark".split()
#: A cross-section: all queries run in the driver's own comparison.
SOME = ["memory_scan", "upsert_merge", "text_search_topk", "text_search_short_query", "hybrid_search_semantic", "hybrid_search_tagged", "repository_stats", "reinforce_from_log", "similar_pairs", "similar_pairs_blended", "leader_clusters", "consolidation_state", "conflict_state", "conflict_classify", "batch_search", "reindex_rebuild", "surrogate_sanitize", "decay_stats", "embedding_prep"]


def plain(df: pd.DataFrame) -> list:
    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NA else f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert plain(QUERIES[name](spark, DIR).toPandas()) == plain(con.sql(SQL[name]).df())


def test_surrogates_in_few_rows_at_a_time_and_null_texts(spark, tmp_path):
    from lorebase.plans.queries import FEW, few_rows

    n = 3 * FEW + 1
    rows = [(k, None if k % 50 == 7 else f"text {k} \U0001f680") for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(QUERIES["surrogate_sanitize"](spark, str(tmp_path)).toPandas()) == plain(con.sql(SQL["surrogate_sanitize"]).df())
    assert [p.num_rows for p in few_rows(pa.RecordBatch.from_pydict({"id": list(range(n))}))] == [FEW, FEW, FEW, 1]
