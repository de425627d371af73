"""All queries and their SQL outside the subpackage for text data."""

from __future__ import annotations

from ohmgrid.plans import laboratory, measurements, relational, reports

MODULES = (measurements, relational, laboratory, reports)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
