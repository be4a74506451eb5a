"""All registered queries by name."""

from __future__ import annotations

from shelfline.plans import documents, features, forecast, quality, reports

GROUPS = (reports, features, forecast, quality, documents)


def queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
