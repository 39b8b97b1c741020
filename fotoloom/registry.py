"""Collects the queries of a module."""

from __future__ import annotations

from collections.abc import Callable

from .session import configured


def collector() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator); the decorator takes the name and, where there is one, the SQL twin."""
    queries: dict = {}
    sql: dict = {}

    def query(name: str, twin: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[name] = lambda spark, sf_dir: f(configured(spark), sf_dir)
            if twin:
                sql[name] = twin
            return f

        return keep

    return queries, sql, query
