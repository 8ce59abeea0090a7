"""Registered queries: a Spark job over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register a job under a name, with the inventory ids it exercises and its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = ops
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
