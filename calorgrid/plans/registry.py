"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """``queries`` and ``sql`` of one module; register with ``@registry("name", "select ...")``."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(fn: Callable) -> Callable:
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return keep
