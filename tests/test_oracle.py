"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_queries_without_sql_run(spark, sf_dir, name):
    """Their values are checked in test_clusters.py."""
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
