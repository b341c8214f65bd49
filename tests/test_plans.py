"""Every named query of the engine against its DuckDB equivalent."""

import pytest
from oracle import assert_equal, connect

from voltmill.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_oracle(spark, sf, con, name):
    assert_equal(registry.QUERIES[name](spark, sf), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
