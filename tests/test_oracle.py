"""Every registered query gives the same rows as its SQL."""

import pytest

import oracle
from ledgerloom import catalog

QUERIES = catalog.all_queries()
ORACLES = catalog.all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    rows, difference = oracle.compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert not difference, difference
    assert rows > 0
