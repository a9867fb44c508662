"""The core's driver queries against their SQL, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from linkspark.plans import maintenance, reference

DIR = "/root/testdata/sf0.001"
ORACLES = reference.ORACLES | maintenance.ORACLES

pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
