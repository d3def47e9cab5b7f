"""Registration of a query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable


def registrar(registered: dict) -> Callable:
    """A decorator ``query(sql)`` that files a function (spark, folder) under its name."""

    def query(sql: str | None = None) -> Callable:
        def file(run: Callable) -> Callable:
            registered[run.__name__] = (run, sql)
            return run

        return file

    return query
