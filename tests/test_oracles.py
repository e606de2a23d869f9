"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__
from graphloom.plans import feature_queries, link_queries, more_queries, queries as plans, wide_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(plain(x) for x in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda rs: [r.replace(".0,", ",").replace(".0)", ")") for r in rs]
    assert norm(rows(got)) == norm(rows(want))
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
