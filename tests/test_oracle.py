"""Every SQL-checkable query equals its DuckDB twin (values, order-insensitive)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.sources.tables import TABLES
from tests.conftest import SF_SMALL

KEYS = sorted(E.oracle_sql())


def _norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    exp = sorted(repr(tuple(_norm(r[dcols.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == exp


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["label", "idx", "split", "n"]
