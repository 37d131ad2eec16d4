"""Each registered query of the reference's own operators against its SQL; those without SQL run and have rows."""

from __future__ import annotations

import pytest

from lexmill.plans.all import ORACLES, QUERIES

from .oracle import SF, check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        check(spark, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
