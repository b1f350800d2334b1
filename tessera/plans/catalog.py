"""Queries of the core by name."""

from __future__ import annotations

from tessera.plans import changes, retrieval

MODULES = (changes, retrieval)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
