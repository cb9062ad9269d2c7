"""Registry of queries with their check SQL side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

# Panels of sources/tables.py, as SQL.
PANEL_A = """pa AS (SELECT CAST(n_regionkey AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS date,
 ln(sum(l_extendedprice)) AS x, sum(l_quantity) AS qty, CAST(count(*) AS BIGINT) AS n
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY 1, 2)"""
PANEL_B = """pb AS (SELECT CAST(s_nationkey AS VARCHAR) AS key,
 CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 ln(sum(l_extendedprice)) AS x, sum(l_quantity) AS qty, CAST(count(*) AS BIGINT) AS n
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY 1, 2)"""


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _expand(sql: str) -> str:
    """r2(..), r4(..), r6(..) stand for rounding to that many digits, with the
    negative zero removed; lists of CTEs are written once as panel names."""
    for digits in (2, 4, 6):
        token = f"r{digits}("
        while True:
            at = _find(sql, token)
            if at < 0:
                break
            depth, i = 1, at + len(token)
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                i += 1
            inner = sql[at + len(token):i - 1]
            sql = f"{sql[:at]}(round(CAST(({inner}) AS DOUBLE), {digits}) + 0.0){sql[i:]}"
    return sql


def _find(sql: str, token: str) -> int:
    at = sql.find(token)
    while at > 0 and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
        at = sql.find(token, at + 1)
    return at


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, _expand(sql) if sql else None)
        return fn
    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: q.run(Tables(spark, folder))
    return {name: bind(q) for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
