"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    found = catalogue.queries()[name](spark, SF)
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "rerank_score" in found.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
