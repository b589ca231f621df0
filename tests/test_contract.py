"""Every registered query of the core on the smallest tables, against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(int(v)) if isinstance(v, bool) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) or "" for i in order) for r in data)


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in registry.SQL:
        rel = db.execute(registry.SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, rel.fetchall())
