import pytest

from tests.oracles import DATA, compare
from voxmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
