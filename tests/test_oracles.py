import pytest

import __spark_entry__
from tests.oracles import DATA, compare
from voxmill.plans import core_queries, reference_queries

ORACLES = {**reference_queries.ORACLES, **core_queries.ORACLES}
QUERIES = {**reference_queries.QUERIES, **core_queries.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
