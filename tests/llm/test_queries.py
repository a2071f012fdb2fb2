"""The registered queries against their SQL."""

import pytest

from lithomesh.llm import registry
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck("sf0.001").sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
