"""Every registered query against its SQL twin on the smallest data."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from emberlog.plans import all_queries, registry  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, text = check.compare(spark, con, name, SF)
    spark.catalog.clearCache()
    assert ok, text


def test_entry(spark):
    assert check.registered.entry(spark).count() > 0


def test_sql_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(NAMES)
    assert set(check.registered.oracle_sql()) <= set(check.registered.queries())
