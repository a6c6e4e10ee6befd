"""Queries that SQL can express, against it."""

import pytest

from atlas.llm import queries
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    mine = queries.queries()[name](spark, sf_dir).toPandas()
    other = duck.sql(queries.oracle_sql()[name]).df()
    assert rows(mine) == rows(other)


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
