"""Every query with SQL must give the same rows and types as DuckDB."""

import pytest

from polyview.plans import ORACLES, QUERIES
from tools.compare import database, difference


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["vec_id", "y", "pred", "score"]
