"""Every registered query against the SQL written for it."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from pricewright.plans.catalog import QUERIES
from pricewright.plans.oracle import ORACLE as SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    assert differences(entry.queries()[name](spark, sf_dir), con, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
