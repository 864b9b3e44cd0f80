"""Every registered query against its check query, over whole tables."""

import os

import pytest

from gradeflow.plans import registry
from tests.oracle import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    assert name in ORACLES
    assert difference(result, con, ORACLES[name]) is None
