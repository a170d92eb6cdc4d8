"""Every catalogued query against DuckDB on the same tables."""

import glob
import os

import pytest

from mvmap.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
    at = [want.columns.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert mine == theirs
