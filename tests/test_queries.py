"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = os.environ.get("MAILSIFT_TEST_DIR", "/root/testdata/sf0.001")
STATEMENTS = entry.oracle_sql()
ROWS_ONLY = sorted(set(entry.queries()) - set(STATEMENTS))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(spark, con, name):
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(mine, con.execute(STATEMENTS[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
