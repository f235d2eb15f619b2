"""Queries of the general data-preparation operators: proximity, units, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayloom.operators.proximity import lines_near_areas
from wayloom.operators.units import normalize_quantities
from wayloom.operators.unpack import unpack_values


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines and the footprints at most 12 m away."""
    buildings = _table(spark, sf_dir, "buildings").withColumnRenamed("id", "building_id")
    return lines_near_areas(_table(spark, sf_dir, "edges"), buildings, 12.0, "ord", "building_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of speed, length and weight tags in common units."""
    return normalize_quantities(
        _table(spark, sf_dir, "tags_dict"), _table(spark, sf_dir, "quantity_keys"), _table(spark, sf_dir, "tag_sources")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of packed highway and cycleway fields."""
    return unpack_values(_table(spark, sf_dir, "edges"), "ord", ["highway", "cycleway"], only_packed=True)


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found}
SQL: dict[str, str] = {}
