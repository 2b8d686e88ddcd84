"""Registers queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable


def registry(prelude: str = "") -> tuple[Callable, dict[str, Callable], dict[str, str]]:
    """A decorator for the queries of a module, and its two tables: functions and SQL by name.  A query's SQL follows the prelude."""
    queries, sqls = {}, {}

    def query(sql: str | None = None, prelude: str = prelude):
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = prelude + sql
            return f

        return add

    return query, queries, sqls
