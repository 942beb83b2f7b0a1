"""Every query of the library against its SQL twin (DuckDB) on the smallest
scale; queries without SQL must run and return rows.  The training-data
operators have their own tests in ``tests/llm``."""

import pytest

import __spark_entry__ as entry
from paths import SF_SMALL
from glossa.plans.registry import all_queries, all_sql
from oracle import compare, connect

QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"threshold", "feature", "language"}
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
