"""Map elements from files of an element service, or from a table of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "elements array<struct<id: bigint, type: string, lat: double, lon: double, nodes: array<bigint>, tags: map<string,string>>>"


def read_elements(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``id, type, lat, lon, nodes, tags``, one row for each element of all files; no element is merged with another.

    The files are JSON documents with an ``elements`` list. Files too large for
    one task should be split by the one who delivers them. Downloading isn't part of this.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(SCHEMA).json(files, multiLine=True).select(F.inline("elements"))


def merge_elements(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; missing columns are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_elements(elements: DataFrame, path: str) -> None:
    """One JSON object an element, in as many files as there are partitions."""
    elements.write.mode("overwrite").json(path)


def elements_from_tags(rows: DataFrame) -> DataFrame:
    """``id, type, tags`` from ``tag_id, element_id, element_type, key, value, edited_at``.

    Of several values of a key the latest edit counts, then the higher
    ``tag_id``, then the greater text; null keys and values are no tags. The
    latest values are found by a partial aggregate, so an element with very many
    records is no single task's burden; a map is as large as its distinct keys.
    """
    latest = (
        rows.where("key is not null and value is not null").groupBy("element_id", "element_type", "key")
        .agg(F.max(F.struct("edited_at", "tag_id", "value")).alias("best"))
    )
    return (
        latest.groupBy(F.col("element_id").alias("id"), F.col("element_type").alias("type"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("best.value").alias("value"))))).alias("tags"))
    )


def examine_tags(elements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``type, key, value, elements``: how many elements have each tag, of all keys or those that begin like one of ``keys``."""
    rows = elements.select("type", F.explode("tags").alias("key", "value"))
    if keys:
        rows = rows.where(F.col("key").rlike("^(" + "|".join(keys) + ")"))
    return rows.groupBy("type", "key", "value").agg(F.count("*").alias("elements"))
