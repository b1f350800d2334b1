"""Queries of this subpackage by name."""

from __future__ import annotations

from tessera.llm import areas, credentials, documented, handwritten, mixing, pieces, similar, syntax, tokens

MODULES = (syntax, similar, credentials, handwritten, pieces, documented, tokens, mixing, areas)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
