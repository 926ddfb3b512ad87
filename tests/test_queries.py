"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from corpuslens.catalog import oracles
from corpuslens.catalog.registry import REGISTRY
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
ORACLE = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, SF, REGISTRY[name], ORACLE[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0
