"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR) == []
    spark.catalog.clearCache()


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 6


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
