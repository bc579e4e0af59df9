"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from registry.oracle import SQL, full_sql
from registry.queries import QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"
# Clusters and folds need more shops and dealers than the smallest tables have.
LARGER = {"classifier_sweep", "order_regression", "cross_month_test"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, full_sql(name)) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01" if name in LARGER else SF).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
