"""Every registered query with check SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from oddspark.plans import load
from tests.conftest import DATA

REGISTRY = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(REGISTRY.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = REGISTRY.QUERIES[name](spark, str(DATA)).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        if d.get("EB05") is not None:
            # a mean need not lie between two quantiles: a small, very low component pulls EBGM below EB05
            assert d["EB05"] <= d["EB95"] and d["EBGM"] > 0
