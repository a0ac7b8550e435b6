"""Registry of named queries: a Spark plan and, where SQL can say it, the DuckDB text to check it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shortfall.oracle.ctes import sql as with_tables
from shortfall.sources.tables import PlanningTables

Plan = Callable[[PlanningTables], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, oracle: str | None = None, tables: dict[str, str] | None = None):
    """Register a plan under a key; `tables` adds table expressions for its SQL."""

    def register(plan: Plan) -> Plan:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = Query(plan, None if oracle is None else with_tables(oracle, tables))
        return plan

    return register
