"""Every query against its SQL, and against the hand-written cases of the quirks."""

import math

import duckdb
import pytest

from readloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "part", "lineitem", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    run, sql = QUERIES[name]
    got, want = run(spark, SF), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isclose(len(set(QUERIES) - set(entry.queries())), 0)
