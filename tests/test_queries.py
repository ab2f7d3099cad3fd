"""Every registered query against its SQL, and what must hold for the registry."""

import pytest

import __spark_entry__ as contract
from flowloom import plans
from oracle import connect, differences

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_query_has_sql():
    assert {name for name in set(QUERIES) - set(ORACLES) if not name.startswith(("op", "pipeline"))} == set()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["src", "dst"]
    assert df.count() > 0
