"""Every catalogued query against its SQL counterpart on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.check_queries import rows_of

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
# Whole runs without SQL are covered by the workflow tests.
SLOW = {"v5_clean_recommended", "v8_n1_analyze"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows_of(rel.columns, rel.fetchall())
