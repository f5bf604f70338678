"""The queries of this subpackage against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entries
from glossaloom.llm import queries
from tests.test_queries import SF, db, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, db, name):  # noqa: F811
    found = queries.queries()[name](spark, SF).toPandas()
    expected = db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(expected, columns)


def test_queries_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entries.queries()) and set(queries.oracle_sql()) <= set(entries.oracle_sql())
