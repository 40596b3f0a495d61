"""The corpus queries that SQL can express, against DuckDB."""

import os

import pytest

from attesta.llm import queries
from tests import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, name):
    oracle.compare(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR)
