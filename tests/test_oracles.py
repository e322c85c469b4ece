"""Every query of the catalog that has SQL, against DuckDB at the smallest scale."""

import pytest

import oracle
from cytoframe import catalog

catalog.load_all()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.skipif(not oracle.available(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows(spark, con, name):
    oracle.check(spark, con, catalog.QUERIES[name], catalog.ORACLES[name])
