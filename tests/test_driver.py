"""Driver contract: entry(), every query at sf0.001 against its DuckDB oracle."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_mod
from textrisk.plans.registry import load_all
from textrisk.sources.readers import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = {n: q for n, q in load_all().items() if q.sql is not None}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["lang", "screened", "candidates", "keyword_hits"] and len(rows) > 0


def test_contract_keys():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    q = ORACLES[name]
    sdf = q.build(spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _bag(sdf.columns, srows) == _bag(dcols, drows)
