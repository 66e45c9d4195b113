"""Every registered query against its DuckDB SQL on the smallest test scale."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from meshwork.plans.registry import load_all
from meshwork.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()
KEYS = sorted(SQL)


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, con, key):
    got = QUERIES[key](spark, SF).toPandas()
    want = con.sql(SQL[key]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["dimension", "total", "positives", "rate_pct"]
    assert df.count() == 5
