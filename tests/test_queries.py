"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

from viatica.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
