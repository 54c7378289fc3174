"""Every registered query against its SQL on an independent engine, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from loglark.plans.oracle import ORACLES
from loglark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF)] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_registry_and_sql_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["ip", "n"] and 0 < df.count() <= 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if name not in entry.oracle_sql():
        return
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)
    assert got == want
