"""Every named query against the SQL that states its result; the others have tests of their own in test_partitions."""

import pytest

from lithomesh.plans import catalog
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck("sf0.001").sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_queries_without_sql_are_held_against_brute_force():
    from tests import test_partitions

    assert {f"test_{name}" for name in set(catalog.QUERIES) - set(catalog.SQL)} <= set(dir(test_partitions))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == catalog.SCENES
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
