"""The registered queries against their oracles, on the smallest tables."""

import pytest
from conftest import SMALL

import check_oracles
from __spark_entry__ import entry, oracle_sql, queries


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) <= set(queries())
    assert all(n == "pipeline" or n.startswith("op") for n in set(queries()) - set(oracle_sql()))


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    verdict = check_oracles.compare(spark, con, SMALL, name)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
