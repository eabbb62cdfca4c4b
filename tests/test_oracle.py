"""Every query with SQL gives DuckDB's rows; every other one runs and gives rows."""

import math
import re

import duckdb
import pytest

from tidewater import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    rel = duck.sql(registry.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_without_llm(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_plans(spark):
    """Top-k per query limits groups before sorting, and SQL-expressible operators run no Python."""
    plan = registry.QUERIES["bm25_batch"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan
    read = registry.QUERIES["min_chars"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in read


def test_score_spread_moves_no_scores(spark):
    """Where no table is small enough to be broadcast for its size, only the documents' side moves to the scores, by id, and of these
    each task's best by query: neither postings by term nor a score for each query and document are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["score_spread"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]
    assert sorted(keys) == ["id", "query_id"] and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
