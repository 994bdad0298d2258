"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check import connect, difference

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_query_has_a_twin():
    from ringside.plans import load_catalog

    queries_, twins = load_catalog()
    assert set(queries_) == set(twins)


def test_entry_gives_rows(spark):
    df = entry(spark)
    assert df.columns[0] == "fighter" and df.count() > 0
