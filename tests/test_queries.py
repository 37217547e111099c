"""Every registered query against its SQL on the smallest tables; the others must run and keep their schema."""

import compare
import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_same_as_sql(spark, con, key):
    assert compare.difference(QUERIES[key](spark, FOLDER), con, ORACLE[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, key):
    df = QUERIES[key](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert registry.entry(spark).count() > 0
