"""Columns worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later filters and columns read instead of repeating.

    A filter on a computed column is pushed below its projection together with a
    copy of the expression; for long geometry expressions that multiplies. A
    generator of one row stops that, and costs no shuffle.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out evenly over as many tasks as the session shuffles into, for steps that cost far more than moving the rows.

    Adaptive execution would otherwise fold few bytes into few tasks, and what
    met in one hot cell would stay in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
