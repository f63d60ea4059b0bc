"""Every catalog query against its SQL on an independent engine."""

import pytest

import __spark_entry__ as contract
from ledgerlynx.plans.catalog import QUERIES
from ledgerlynx.plans.oracles import ORACLES
from oracle_check import connect, differences



@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, folder, name):
    assert differences(spark, con, folder, name, QUERIES[name], ORACLES.get(name)) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_contract_has_the_catalog():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.count() == 1633 and "decision" in out.columns
