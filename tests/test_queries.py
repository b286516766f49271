"""Every registered query against its oracle SQL in DuckDB."""

import compare
import pytest

import __spark_entry__ as contract
from pagemill.plans import catalog, oracles

QUERIES, ORACLES = dict(catalog.QUERIES), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracles.oracle_sql(catalog.CRAWL_DEPTH, catalog.CRAWL_CAP))
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_dir, name):
    assert compare.difference(spark, duck, QUERIES[name], ORACLES[name], sf_dir) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["seed", "links", "distinct_links"]
