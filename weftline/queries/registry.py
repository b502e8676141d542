"""Names of queries, what they run, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.query import Query
from weftline.sources.tables import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _new(name: str) -> str:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    return name


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, tables by name)."""
    _new(name)

    def add(fn: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, register(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def sql_query(name: str, text: str, args: dict[str, Any] | None = None, oracle: str | None = None) -> None:
    """Registers a parameterised query; its SQL with literals in place of parameters is the check if none is given."""
    parsed = Query.parse(_new(name), text)
    QUERIES[name] = lambda spark, sf_dir: (register(spark, sf_dir), parsed.run(spark, **(args or {})))[1]
    if oracle is None:
        oracle = parsed.sql
        for p, value in sorted((args or {}).items(), key=lambda a: -len(a[0])):
            literal = f"'{value}'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
            oracle = oracle.replace(f":{p}", literal)
    ORACLES[name] = oracle
