"""Every catalogue query against its oracle SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from brindle import catalog

DIR = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    cur = duck.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(cols)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(([_norm(v) for v in r] for r in cur.fetchall()), key=key)
    have = sorted(([_norm(r[c]) for c in cols] for r in got.collect()), key=key)
    assert have == want
