import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from mhqa.plans import queries as Q

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return str(int(value) if isinstance(value, float) and value.is_integer() else value)


@pytest.fixture(scope="module")
def views(data):
    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and Q.QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, data, views, name):
    df = Q.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = views.sql(Q.SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_query_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() >= 0
