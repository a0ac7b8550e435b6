"""Every registered query against its DuckDB text on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry

PLANS, ORACLES = entry.queries(), entry.oracle_sql()
# A report without a finding is right there where the small tables have none.
MAY_BE_EMPTY = {"scenario_sku_exposure", "scenario_worsened", "risk_search", "filter_semi", "dq_split_totals"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_duckdb(spark, duck, key):
    problems = compare(PLANS[key](spark, SMALL), duck, ORACLES[key])
    if key in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "EMPTY"]
    assert not problems


@pytest.mark.parametrize("key", sorted(set(PLANS) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, key):
    assert PLANS[key](spark, SMALL).count() > 0


def test_every_oracle_has_a_plan():
    assert set(ORACLES) <= set(PLANS)


def test_flagship_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() == 200
