"""Every registered query against its DuckDB oracle on the smallest testdata."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_compare import SF_SMALL, compare

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, ORACLE[name], duck_small)
    assert ok, msg


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"Compound", "stint_lap_number", "mean_delta"} <= set(df.columns)
