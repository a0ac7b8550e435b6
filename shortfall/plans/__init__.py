"""Named queries by theme."""

from shortfall.plans import business, evidence, intake, planning, scans, tables  # noqa: F401
from shortfall.plans.registry import QUERIES

__all__ = ["QUERIES"]
