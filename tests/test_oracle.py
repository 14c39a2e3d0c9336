"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle_check import connect, difference

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    found = difference(con, QUERIES[name](spark, sf_dir), ORACLE[name])
    assert found is None


def test_sql_only_for_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["record_number", "span_no", "aspect", "value"]
    assert rows.count() > 0
