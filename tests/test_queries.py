"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, differences

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert differences(got, duck.sql(ORACLES[name]).to_df()).startswith("ok")


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
