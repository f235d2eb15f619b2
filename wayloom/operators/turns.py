"""Turns at intersections, as a table: every edge into a node joined with every edge out of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions.scalar import normalize_azimuth, turn_direction


def build_turns(edges: DataFrame, order: str = "ord", level: str | None = None, straight: float = 20.0) -> DataFrame:
    """One row for each pair of an edge ending and an edge beginning at a node, U-turns included.

    ``edges`` has ``u, v, key, geometry`` and a column that orders them. ``turn_u``
    is ``<node>_in<n>`` and ``turn_v`` ``<node>_out<n>``, numbered from 0 in that
    order. Among the turns of one entry, U-turns apart, the first and the last
    counter-clockwise are 'near', those between 'far'; U-turns are 'near'. A turn
    crosses traffic (``turn_across``) unless it is a near right, or goes straight
    where there is no right. Edges without geometry have turns without azimuth,
    direction and proximity. Two shuffles bring the ends together, one orders
    the turns of an entry; a node's degree bounds what meets there.
    """
    e = edges.select(
        "u", "v", "key", F.col(order).alias("_o"), *([F.col(level).alias("_level")] if level else []),
        L.azimuth_at(F.col("geometry"), 0.0).alias("_from"), L.azimuth_at(F.col("geometry"), 1e300).alias("_to"),
    )
    levels = ["_level"] if level else []
    out = e.select(
        F.col("u").alias("u_out"), F.col("v").alias("v_out"), F.col("key").alias("key_out"), F.col("_from").alias("out_azimuth"), *[F.col(x).alias("out_level") for x in levels],
        F.concat_ws("", F.col("u").cast("string"), F.lit("_out"), (F.row_number().over(Window.partitionBy("u").orderBy("_o", "v", "key")) - 1).cast("string")).alias("turn_v"),
    )
    into = e.select(
        F.col("u").alias("u_in"), F.col("v").alias("v_in"), F.col("key").alias("key_in"), F.col("_to").alias("in_azimuth"), *[F.col(x).alias("in_level") for x in levels],
        F.concat_ws("", F.col("v").cast("string"), F.lit("_in"), (F.row_number().over(Window.partitionBy("v").orderBy("_o", "u", "key")) - 1).cast("string")).alias("turn_u"),
    )
    turns = into.join(out, F.col("v_in") == F.col("u_out")).withColumn("osmid", F.col("v_in"))
    turns = turns.withColumn("relative_azimuths", normalize_azimuth(F.col("out_azimuth") - F.col("in_azimuth")))
    turns = turns.withColumn("turn_direction", turn_direction(F.col("relative_azimuths"), straight))
    u_turn = F.col("turn_direction") == "U"
    entry = Window.partitionBy("turn_u", F.coalesce(u_turn, F.lit(True))).orderBy("relative_azimuths", "turn_v")
    rank, last = F.row_number().over(entry), F.count("*").over(Window.partitionBy("turn_u", F.coalesce(u_turn, F.lit(True))))
    proximity = F.when(u_turn, "near").when(F.col("turn_direction").isNotNull(), F.when((rank == 1) | (rank == last), "near").otherwise("far"))
    turns = turns.withColumn("turn_proximity", proximity)
    any_right = F.coalesce(F.max((F.col("turn_direction") == "right").cast("int")).over(Window.partitionBy("turn_u")), F.lit(0)) > 0
    near_right = (F.col("turn_direction") == "right") & (F.col("turn_proximity") == "near")
    return turns.withColumn("turn_across", ~near_right & ~((F.col("turn_direction") == "straight") & ~any_right))


def between_exits(turns: DataFrame) -> DataFrame:
    """``turn_u, turn_v, osmid`` between any two different exits of a node, so that no exit is a dead end for whoever starts there."""
    exits = turns.select("osmid", "turn_v").distinct()
    other = exits.select("osmid", F.col("turn_v").alias("_to"))
    return exits.join(other, "osmid").where(F.col("turn_v") != F.col("_to")).select(F.col("turn_v").alias("turn_u"), F.col("_to").alias("turn_v"), "osmid")


def attach_edge_attributes(turns: DataFrame, edges: DataFrame, attributes: Sequence[str] = (), level: str | None = None) -> DataFrame:
    """Attributes of the edge in (``_in``) and the edge out (``_out``) of each turn.

    With ``level`` also ``in_level, out_level, delta_level``, the highest level at
    the node (``max_level``) and the highest level reached by a left or right turn
    of the same entry (``cross_level``; where there is none, ``max_level``).
    """
    wanted = [*dict.fromkeys([*attributes, *([level] if level else [])])]
    wanted = [a for a in wanted if a not in ("u", "v", "key")]
    for end in ("in", "out"):
        own = edges.select(*[F.col(k).alias(f"{k}_{end}") for k in ["u", "v", "key", *wanted]])
        turns = turns.join(own, [f"u_{end}", f"v_{end}", f"key_{end}"], "left")
    if level:
        turns = turns.withColumns({"in_level": F.col(f"{level}_in"), "out_level": F.col(f"{level}_out")}).withColumn("delta_level", F.col("out_level") - F.col("in_level"))
        turns = turns.withColumn("max_level", F.max(F.greatest("in_level", "out_level")).over(Window.partitionBy("osmid")))
        side = F.max(F.when(F.col("turn_direction").isin("left", "right"), F.col("out_level"))).over(Window.partitionBy("turn_u"))
        turns = turns.withColumn("cross_level", F.coalesce(side, F.col("max_level")))
    return turns


def attach_turn_ids(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """``turn_u`` and ``turn_v`` of each edge: where turns deliver to it and take from it; without turns its own nodes."""
    begins = turns.groupBy(F.col("u_out").alias("u"), F.col("v_out").alias("v"), F.col("key_out").alias("key")).agg(F.min("turn_v").alias("turn_u"))
    ends = turns.groupBy(F.col("u_in").alias("u"), F.col("v_in").alias("v"), F.col("key_in").alias("key")).agg(F.min("turn_u").alias("turn_v"))
    out = edges.join(begins, ["u", "v", "key"], "left").join(ends, ["u", "v", "key"], "left")
    return out.withColumns({"turn_u": F.coalesce("turn_u", F.col("u").cast("string")), "turn_v": F.coalesce("turn_v", F.col("v").cast("string"))})


def combine_edges_and_turns(edges: DataFrame, turns: DataFrame, attributes: Sequence[str] = (), level: str | None = None) -> DataFrame:
    """Edges and turns in one table, linked by ``turn_u`` and ``turn_v``; only turns both of whose edges are given."""
    ids = edges.select("u", "v", "key")
    for end in ("in", "out"):
        turns = turns.join(ids.select(*[F.col(k).alias(f"{k}_{end}") for k in ids.columns]), [f"u_{end}", f"v_{end}", f"key_{end}"], "left_semi")
    turns = attach_edge_attributes(turns, edges, attributes, level)
    ends = [f"{k}_{end}" for k in ("u", "v", "key") for end in ("in", "out")]
    return attach_turn_ids(edges, turns).unionByName(turns.drop(*ends), allowMissingColumns=True)
