"""The text queries against their SQL, over the smallest tables."""

import pytest

from checks.compare import database, differences, type_differences
from trackweave.llm.oracles import ORACLES
from trackweave.llm.queries import REGISTRY

TABLES = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = REGISTRY[name](spark, TABLES)
    want = database(TABLES).sql(ORACLES[name])
    assert type_differences(got, want) == ""
    expected = want.df()
    assert len(expected) > 0
    assert differences(got.toPandas(), expected) == ""
