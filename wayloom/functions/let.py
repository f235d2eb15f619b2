"""Binding a sub-expression once, for reuse inside a larger Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
