"""Buildings beside streets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.functions.scalar import azimuth, degrees_centered_at_zero, side_by_relative_angle
from wayloom.operators.proximity import lines_near_areas
from wayloom.operators.staged import spread, staged


def nearby_buildings(edges: DataFrame, buildings: DataFrame, primary: float, secondary: float, key: str = "ord") -> DataFrame:
    """``key, r_distance, r_buildings, l_distance, l_buildings``: what stands on each side of each edge.

    Of the buildings within ``primary`` of the edge, on each side those at most
    ``secondary`` farther than the nearest, and never beyond ``primary``; ids in
    order. The side is that of the building's centre. Buildings straight ahead
    or behind have no side. A side without buildings is null; edges without any
    have no row. A row for each edge is what its buildings make, so a street's
    length bounds it.
    """
    pairs = lines_near_areas(edges, buildings.withColumnRenamed("id", "_bid"), primary, key, "_bid", measure="_d")
    e = edges.select(key, F.col("geometry").alias("g")).where("g is not null").dropDuplicates([key])
    b = buildings.where("geometry is not null").select(F.col("id").alias("_bid"), P.centroid(F.col("geometry")).alias("_c")).dropDuplicates(["_bid"])
    both = spread(pairs.join(e, key).join(b, "_bid"), key, "_bid")
    both = staged(both, {"_n": L.nearest(F.col("_c"), F.col("g"))})
    turn = azimuth(F.col("_n.x"), F.col("_n.y"), F.col("_c.x"), F.col("_c.y")) - L.azimuth_at(F.col("g"), F.col("_n.place"))
    sided = staged(both, {"_turn": turn}).select(key, "_bid", "_d", side_by_relative_angle(degrees_centered_at_zero(F.col("_turn"))).alias("side")).where(F.col("side").isin("R", "L"))
    reach = F.least(F.min("_d").over(Window.partitionBy(key, "side")) + secondary, F.lit(float(primary)))
    kept = sided.withColumn("_reach", reach).where(F.col("_d") <= F.col("_reach"))
    of = lambda s: [F.max(F.when(F.col("side") == s, F.col("_reach"))).alias(f"{s.lower()}_distance"), F.collect_list(F.when(F.col("side") == s, F.col("_bid"))).alias(f"{s.lower()}_buildings")]
    out = kept.groupBy(key).agg(*of("R"), *of("L"))
    return out.withColumns({f"{s}_buildings": F.when(F.size(f"{s}_buildings") > 0, F.array_sort(f"{s}_buildings")) for s in ("r", "l")})
