"""Every query of the library against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sitesignal.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_points(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).limit(1).count() == 1
