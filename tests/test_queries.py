"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from tidewatch.testbed.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    compare(QUERIES[name](spark, SF), con, ORACLES[name])
