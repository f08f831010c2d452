"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.compare import connected, difference
from tidemark import plans

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connected(SF_DIR)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_like_sql(spark, con, name):
    assert difference(plans.QUERIES[name](spark, SF_DIR), con, plans.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF_DIR).columns
