"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import oracle
from scholion.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    ours, theirs = oracle.rows_of(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ours == theirs
