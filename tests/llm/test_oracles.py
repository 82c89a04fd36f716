import pytest

from millrace.llm import queries
from tests.oracle import compare, connection


@pytest.mark.parametrize("key", ["op2_winnowing_decontamination", "op7_substring_dedup", "op8_url_templates"])
def test_query_matches_its_oracle(spark, sf, key):
    assert compare(queries.QUERIES[key](spark, sf), connection(sf), queries.ORACLES[key]) is None
