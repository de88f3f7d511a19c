"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from stepforge.plans import catalogue

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (decimal.Decimal, float)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.collect()) > 0
