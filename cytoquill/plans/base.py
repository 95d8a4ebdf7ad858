"""The registry's tables and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def unsigned_zeros(sql: str) -> str:
    """SQL in which each ``round(...)`` gives 0.0 rather than -0.0, as Spark's does."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        end, depth = start + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:start] + "(round(" + unsigned_zeros(sql[start + 6 : end - 1]) + ") + 0.0)"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = unsigned_zeros(sql)
        return f

    return add
