"""Registering a query with its oracle."""
from __future__ import annotations

from collections.abc import Callable


def family() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query
