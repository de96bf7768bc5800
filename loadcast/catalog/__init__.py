"""Registered queries: each operator on the given tables, with the SQL that must agree with it."""

from loadcast.catalog import (
    aggregates,
    cleaning,
    forecasting,
    functions,
    ordering,
    storage,
    windows,
)

MODULES = (storage, cleaning, aggregates, windows, ordering, functions, forecasting)


def all_queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.REGISTRY.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.REGISTRY.items() if sql}
