"""Every registered query with its SQL twin."""

from __future__ import annotations

from lumenframe.plans import build, calibration, field, measure, scoring, skyjoin  # noqa: F401  they register their queries
from lumenframe.plans.registry import OPERATORS, QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def operators() -> dict[str, str]:
    """The survey's identifiers that each query exercises."""
    return dict(OPERATORS)
