"""Every query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from pagewright.plans import catalogue

from .harness import compare, duck

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    assert name in ORACLES
    rows, difference = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert difference is None
    assert rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_entry_has_the_catalogue():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
