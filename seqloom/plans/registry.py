"""Named queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

Query = Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.oracle[name or f.__name__] = sql
            return f

        return add
