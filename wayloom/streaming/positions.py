"""Streams of positions against lines and areas that stand still.

The static side is dealt out over cells once; each micro-batch joins on the cell,
so no state is kept but that of windows, which watermarks bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.functions.let import point


def _cells(df: DataFrame, points, grow: float, cell: float) -> DataFrame:
    b = P.bounds(points)
    steps = lambda lo, hi: F.sequence(F.floor((b[lo] - grow) / cell), F.floor((b[hi] + grow) / cell))
    return df.where(F.size(points) > 0).withColumn("_cx", F.explode(steps("minx", "maxx"))).withColumn("_cy", F.explode(steps("miny", "maxy")))


def _placed(stream: DataFrame, cell: float) -> DataFrame:
    return stream.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})


def positions_in_areas(stream: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """Rows of a stream (``x, y, ...``) with ``area_id`` of each area (``id, geometry``) that holds them."""
    static = _cells(areas.select(F.col("id").alias("area_id"), F.col("geometry").alias("_area")), F.get("_area", F.lit(0)), 0.0, cell)
    joined = _placed(stream, cell).join(static, ["_cx", "_cy"])
    return joined.where(P.contains(F.col("_area"), point(F.col("x"), F.col("y")))).drop("_cx", "_cy", "_area")


def counts_in_areas(stream: DataFrame, areas: DataFrame, cell: float, time: str, window: str, lateness: str) -> DataFrame:
    """Positions in each area by time window, for append mode; rows later than ``lateness`` are dropped."""
    inside = positions_in_areas(stream.withWatermark(time, lateness), areas, cell)
    return inside.groupBy(F.window(time, window), "area_id").agg(F.count("*").alias("positions")).select(F.col("window.start").alias("start"), "area_id", "positions")


def positions_near_lines(stream: DataFrame, lines: DataFrame, distance: float, cell: float | None = None) -> DataFrame:
    """Rows of a stream with ``line_id, distance, place`` of each line (``id, geometry``) within a distance."""
    side = cell or 4 * distance
    static = _cells(lines.select(F.col("id").alias("line_id"), F.col("geometry").alias("_line")), F.col("_line"), distance, side)
    joined = _placed(stream, side).join(static, ["_cx", "_cy"]).withColumn("_n", L.nearest(point(F.col("x"), F.col("y")), F.col("_line")))
    return joined.where(F.col("_n.distance") <= distance).select(*stream.columns, "line_id", F.col("_n.distance").alias("distance"), F.col("_n.place").alias("place"))
