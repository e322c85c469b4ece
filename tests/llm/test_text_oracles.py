"""The text queries that have SQL, against DuckDB at the smallest scale."""

import pytest

import oracle
from cytoframe.llm import queries


@pytest.mark.skipif(not oracle.available(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, name):
    oracle.check(spark, oracle.connect(), queries.queries()[name], queries.oracle_sql()[name])
