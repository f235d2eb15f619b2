"""Frames from shapes at hand, empty frames, and tables laid out by cells of the plane."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import polygon as P

LINE, AREA = "array<struct<x:double,y:double>>", "array<array<struct<x:double,y:double>>>"


def shapes_to_frame(spark: SparkSession, shapes: Iterable, kind: str = "line") -> DataFrame:
    """``id, geometry`` of lines (lists of (x, y)) or areas (lists of rings), numbered from 0."""
    return spark.createDataFrame(list(enumerate(shapes)), f"id bigint, geometry {LINE if kind == 'line' else AREA}")


def empty_frame(spark: SparkSession, fields: dict[str, str], rows: int = 0) -> DataFrame:
    """``rows`` rows of nulls with columns of the types named."""
    return spark.range(rows).select(*[F.lit(None).cast(k).alias(n) for n, k in fields.items()])


def write_by_cells(df: DataFrame, path: str, points: Column, cell: float) -> None:
    """Parquet in folders by cell column, and within them sorted by row, so that a window reads few files.

    A feature lies in the cell of its box's lower left corner; ``read_window``
    looks far enough to the left and down for the largest box, which it reads
    from the files' own columns.
    """
    b = P.bounds(points)
    boxed = df.withColumns({"_minx": b["minx"], "_miny": b["miny"], "_maxx": b["maxx"], "_maxy": b["maxy"]}).where("_minx is not null")
    placed = boxed.withColumns({"_cx": F.floor(F.col("_minx") / cell), "_cy": F.floor(F.col("_miny") / cell)})
    placed.repartitionByRange("_cx", "_cy").sortWithinPartitions("_cx", "_cy").write.mode("overwrite").partitionBy("_cx").parquet(path)


def read_window(spark: SparkSession, path: str, minx: float, miny: float, maxx: float, maxy: float, largest: float, cell: float) -> DataFrame:
    """Features whose box meets a window; ``largest`` is the widest box there is. Folders and row groups beyond it aren't read."""
    df = spark.read.parquet(path)
    near = F.col("_cx").between(int((minx - largest) // cell), int(maxx // cell))
    meets = (F.col("_minx") <= maxx) & (F.col("_maxx") >= minx) & (F.col("_miny") <= maxy) & (F.col("_maxy") >= miny)
    return df.where(near & meets).drop("_minx", "_miny", "_maxx", "_maxy", "_cx", "_cy")


def rename_geometry(df: DataFrame, current: str) -> DataFrame:
    """The geometry column under the name ``geometry``, last."""
    renamed = df.withColumnRenamed(current, "geometry")
    return renamed.select(*[c for c in renamed.columns if c != "geometry"], "geometry")


def edge_columns(df: DataFrame, u: str, v: str, key: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """An edge table with the usual names; without a key, 0."""
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"), (F.col(key) if key else F.lit(0)).alias("key"), *[c for c in (keep or df.columns) if c not in (u, v, key)])
