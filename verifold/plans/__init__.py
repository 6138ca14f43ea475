"""Registered queries: each module has QUERIES and SQL."""

from __future__ import annotations

from . import intake_queries, relational_queries, stream_queries, text_queries, verdict_queries

MODULES = (verdict_queries, relational_queries, text_queries, intake_queries, stream_queries)


def plans() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
