"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from marketlake.plans import registry
from tests.compare import connect, difference

ORACLE = entry.oracle_sql()
# Queries of the subpackage for training text have tests of their own.
QUERIES = {name: query for name, query in entry.queries().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE)
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "item_id"
