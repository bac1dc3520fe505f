"""Every registered query against its check SQL in DuckDB."""

import decimal

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry_points

QUERIES = {n: q for n, q in entry_points.queries().items() if n not in entry_points.CORPUS_QUERIES}
CHECKS = {n: q for n, q in entry_points.oracle_sql().items() if n not in entry_points.CORPUS_CHECKS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    return str(value) if isinstance(value, decimal.Decimal) else repr(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(row[i]) for i in where) for row in cursor.fetchall())


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["school_id", "feed_rank", "id", "final_score"]
    assert df.count() > 0
