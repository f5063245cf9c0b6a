"""Every registered query against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return str(int(x)) if isinstance(x, (int, float)) and float(x).is_integer() and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns, rows = sorted(got.columns), got.collect()
    if name not in entry.oracle_sql():
        return
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = [dict(zip(names, x)) for x in r.fetchall()]
    assert columns == sorted(names)
    assert sorted([plain(x[c]) for c in columns] for x in rows) == sorted([plain(x[c]) for c in columns] for x in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
