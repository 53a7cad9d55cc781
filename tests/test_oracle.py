"""Every registered query against its SQL statement, on the smallest test data."""

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == []


def test_entry(spark):
    assert driver.entry(spark).columns[0] == "Country"


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
