"""Driver contract: entry runs; every query matches its DuckDB oracle on the
smallest scale factor (the driver repeats this at sf0.01)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from hostlens.plans.registry import ORACLES, QUERIES, load_all
from hostlens.sources.tables import RAW_TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"VIRUS_GENUS", "n"}


def test_every_query_has_an_oracle():
    load_all()
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


load_all()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(ORACLES[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    orows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == orows
