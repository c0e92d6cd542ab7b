"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.queries import FAMILIES, registered
from tessera.sources.bindings import Tables

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, duck, name):
    plan, sql = registered()[name]
    df = plan(Tables(spark, FOLDER))
    got = df.collect()
    if sql is None:
        assert df.columns
        return
    c = duck.execute(sql)
    names = [d[0] for d in c.description]
    want = c.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    a = sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(k)]) for k in order) for r in want), key=repr)
    assert a == b


def test_families():
    assert len(FAMILIES) == 11
