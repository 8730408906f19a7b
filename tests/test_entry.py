"""Every registered query runs; those with SQL agree with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import canonical
from geoloom.fixtures import RAW

SF_DIR = "/root/testdata/sf0.001"
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for raw in RAW:
        con.execute(f"create view {raw} as select * from '{SF_DIR}/{raw}.parquet'")
    return con


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, db, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    got = canonical(df.columns, df.collect())
    assert got[0]
    if name in SQL:
        cursor = db.execute(SQL[name])
        assert got == canonical([d[0] for d in cursor.description], cursor.fetchall())
