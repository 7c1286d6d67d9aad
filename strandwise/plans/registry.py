"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator): the decorator takes the DuckDB SQL, if there is any."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
