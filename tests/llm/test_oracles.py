"""The llm queries that SQL can express against their SQL."""

import pytest

from sediment.llm import queries

from ..oracle import connected, same


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connected(sf), queries.ORACLE_SQL[name])
