"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from attesta.plans import catalogue

from . import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    oracle.compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF_DIR)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    frame = catalogue.QUERIES[name](spark, SF_DIR)
    assert frame.columns
    assert frame.count() >= 0
