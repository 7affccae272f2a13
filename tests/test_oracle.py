"""Every registered query against its SQL twin."""

import pytest

from oracles import all_sql
from oracles.check import compare, connect
from threatlake.plans import load_queries

QUERIES, SQL = load_queries(), all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, QUERIES[name], SQL[name]).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
