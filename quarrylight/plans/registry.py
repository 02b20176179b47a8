"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, sql: dict) -> Callable:
    """A decorator that registers a query, and its SQL where there is some, under the function's name."""

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return query
