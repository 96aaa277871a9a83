"""Where queries put themselves: a name, a function of (spark, sf_dir), and SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its own name."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def r(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; a zero without a sign."""
    return F.round(value, digits) + F.lit(0.0)


def sql_r(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0"
