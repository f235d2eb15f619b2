"""Reading the tables, and what the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value: Column, name: str, places: int = 4) -> Column:
    """Rounded, so that the last bits of two engines don't matter; adding 0 turns -0 into 0."""
    return (F.round(value, places) + F.lit(0.0)).alias(name)


# SQL fragments over a list of points g (DuckDB lambdas)
SQL_LENGTH = "coalesce(list_sum(list_transform(range(1, len(g)), lambda i: sqrt(pow(g[i+1].x-g[i].x,2)+pow(g[i+1].y-g[i].y,2)))),0)"
