"""Registered queries: each module states its queries and their DuckDB equivalents."""

from foralia.plans import evaluation, grounded, law, retrieval, sinks, tax

MODULES = (tax, retrieval, law, grounded, sinks, evaluation)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
