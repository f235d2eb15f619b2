"""All queries of the core, by name, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayloom.plans import conflate, lines, more, network, problems, rest, scalars, spatial, tags

MODULES = [conflate, spatial, scalars, lines, tags, network, more, rest, problems]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
