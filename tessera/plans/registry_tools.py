"""What every module of registered queries starts with."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(QUERIES, SQL, query): two dictionaries and the decorator that fills them."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if text:
                sql[fn.__name__] = text
            return fn

        return add

    return queries, sql, query
