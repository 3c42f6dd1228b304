"""Every registered query of the catalog against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog.check import compare
from catalog.queries import QUERIES
from tests.conftest import SF


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, _, note = compare(spark, SF, name)
    assert ok, note


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 23 and sum(r.hits for r in rows) > 200
