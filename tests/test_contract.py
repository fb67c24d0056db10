"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from pressroom.contract.queries import QUERIES as OWN
from tests.compare import connect, differences

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, db, sf_dir, name):
    assert name in ORACLE
    assert differences(spark, db, sf_dir, QUERIES[name], ORACLE[name]) is None
