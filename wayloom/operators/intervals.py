"""Intervals and runs over rows, by windows within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Keys, ``lo``, ``hi`` of merged closed intervals; touching ones merge. Rows without both ends are left out."""
    rows = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    by = Window.partitionBy(*keys).orderBy("_lo", "_hi")
    reach = F.max("_hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("_new", F.when(reach >= F.col("_lo"), 0).otherwise(1))
    numbered = starts.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("_lo").alias(lo), F.max("_hi").alias(hi)).drop("_island")


def gaps(df: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The open stretches between the islands of each key."""
    merged = islands(df, keys, lo, hi)
    by = Window.partitionBy(*keys).orderBy(lo)
    return merged.select(*keys, F.col(hi).alias("_lo"), F.lead(lo).over(by).alias("_hi")).where("_hi is not null").select(*keys, F.col("_lo").alias(lo), F.col("_hi").alias(hi))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` plus ``run``, counting from 1 within the key: rows next to each other with equal values (nulls equal) share one."""
    by = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(value).over(by).eqNullSafe(F.col(value)) & (F.row_number().over(by) > 1)
    return df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
