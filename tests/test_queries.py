"""Queries against their SQL on the smallest driver tables, and queries without SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from finquill.plans.every import SQL, Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, order):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.4f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = Q[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got.collect(), [got.columns.index(c) for c in columns]) == plain(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_procedural_queries_run(spark, name):
    got = Q[name](spark, DATA)
    assert len(got.collect()) > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 25
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
