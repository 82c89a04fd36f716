import pytest

from millrace.plans import registry
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_matches_its_oracle(spark, sf, con, key):
    assert compare(registry.QUERIES[key](spark, sf), con, registry.ORACLES[key]) is None
