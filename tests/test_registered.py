"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.difference(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
