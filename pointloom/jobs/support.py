"""What the query modules share: rounding, registration, SQL pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.fixtures import with_sql

DIGITS = 6


def r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded for comparison, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rs(expr: str, digits: int = DIGITS) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


class Registry:
    """Queries of a module, each with its SQL where SQL can say it."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


__all__ = ["DIGITS", "Registry", "big", "r", "rs", "with_sql"]
