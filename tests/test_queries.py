"""Registered queries against their SQL counterparts on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(set(entry.queries()) & set(entry.oracle_sql()))


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == cols
    want = [tuple(plain(r[order.index(c)]) for c in cols) for r in cur.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
