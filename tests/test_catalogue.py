"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lattica import catalogue

SLOW = {"varlen_reach", "algo_mst"}


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalogue.SQL:
        return
    out = duck.sql(catalogue.SQL[name])
    assert sorted(out.columns) == columns
    place = [out.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[k]) for k in place)) for r in out.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == want
