"""Every query with an SQL statement gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import frames_equal, tables

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    tables(c, SF)
    return c


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert frames_equal(got, con.execute(SQL[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 3
