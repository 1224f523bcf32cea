"""Every registered query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as registered
from tests.compare import difference, oracle_connection

# The training-data operators have tests of their own.
QUERIES = {
    name: query for name, query in registered.queries().items()
    if not re.match(r"op\d+_|pipeline$", name)
}
SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees(name, spark, small, connection):
    assert difference(QUERIES[name](spark, small), connection, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
