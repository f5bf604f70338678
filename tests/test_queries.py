"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entries
from glossaloom.plans import catalogue, stored

QUERIES, SQL = catalogue.queries() | stored.queries(), catalogue.oracle_sql() | stored.oracle_sql()
SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF).toPandas()
    expected = db.sql(SQL[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(expected, columns)


def test_entry(spark):
    assert entries.entry(spark).count() > 0
