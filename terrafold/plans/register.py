"""Queries under their names, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def named(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add

    def query(self, sql: str | None = None) -> Callable:
        return lambda f: self.named(f.__name__, sql)(f)
