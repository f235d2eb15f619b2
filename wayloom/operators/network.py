"""Networks as two tables: ``nodes`` (node, x, y, ...) and ``edges`` (u, v, key, geometry, length, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from wayloom.functions import line as L
from wayloom.session import checkpointed

#: Rounds of pointer doubling at most: chains of up to 2 ** MAX_DOUBLINGS edges.
MAX_DOUBLINGS = 40
EPSILON = 0.5e-6


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones, whose missing length is that of their geometry."""
    filled = new.withColumn("length", F.coalesce("length", L.length(F.col("geometry")))) if "length" in new.columns else new.withColumn("length", L.length(F.col("geometry")))
    return edges.unionByName(filled, allowMissingColumns=True)


def ensure_length(edges: DataFrame, default: float | None = 0.0) -> DataFrame:
    """``edges`` whose missing length is that of their geometry, and without one ``default``; recorded lengths stay, 0 too."""
    drawn = F.when(F.size("geometry") > 0, L.length(F.col("geometry"))) if "geometry" in edges.columns else F.lit(None).cast("double")
    known = F.col("length").cast("double") if "length" in edges.columns else F.lit(None).cast("double")
    return edges.withColumn("length", F.coalesce(F.nanvl(known, F.lit(None).cast("double")), drawn, F.lit(default)))


def set_turn_lengths(edges: DataFrame, right: float = 0.0, left: float = 0.0, straight: float = 0.0, u_turn: float = 0.0) -> DataFrame:
    """``length`` of turns (rows with a ``turn_direction``) by their direction; others keep theirs."""
    by = F.col("turn_direction")
    cost = F.when(by == "right", right).when(by == "left", left).when(by == "straight", straight).when(by == "U", u_turn)
    return edges.withColumn("length", F.coalesce(cost, F.col("length").cast("double")))


def field_calculate(table: DataFrame, name: str, function: Column | Callable, kind: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A new column of nodes or edges: an expression, or a Python function of a row's values (a dict), run in Arrow batches.

    A Python function needs the new column's ``kind`` and sees ``columns``, by
    default all; it gets ids like any other value. A column of that name is
    replaced, as far as the function sees it from its old value.
    """
    if isinstance(function, Column):
        return table.withColumn(name, function)
    seen = list(columns or table.columns)
    schema = _parse_datatype_string(kind)
    made = to_arrow_type(schema)

    def each(rows: pa.Array) -> pa.Array:
        return pa.array([function(row) for row in rows.to_pylist()], made)

    return table.withColumn(name, F.arrow_udf(each, schema)(F.struct(*seen)))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("u", "v", "key"), ["u", "v", "key"], "left_anti")


def backward_edges(edges: DataFrame, order: str, oneway: str = "oneway") -> DataFrame:
    """With a reversed copy of each edge that isn't one-way, then the first of each (u, v, key), originals before copies.

    A null ``oneway`` is two-way. Geometries of copies run backwards.
    """
    back = edges.where(~F.coalesce(F.col(oneway), F.lit(False))).withColumns({"u": F.col("v"), "v": F.col("u"), "geometry": F.reverse("geometry")})
    both = edges.withColumn("_copy", F.lit(0)).unionByName(back.withColumn("_copy", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("u", "v", "key").orderBy("_copy", order))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_copy")


def edges_to_digraph(edges: DataFrame, order: str) -> DataFrame:
    """The last edge of each (u, v), as where parallel edges overwrite one another."""
    last = F.row_number().over(Window.partitionBy("u", "v").orderBy(F.col(order).desc()))
    return edges.withColumn("_n", last).where("_n = 1").drop("_n")


def subgraph_by_attribute(edges: DataFrame, attribute: str, values: Sequence) -> DataFrame:
    """Edges whose attribute, a value or an array, is or holds one of ``values``; null ones aren't."""
    kind = dict(edges.dtypes)[attribute]
    wanted = F.array(*[F.lit(v) for v in values])
    return edges.where(F.arrays_overlap(attribute, wanted) if kind.startswith("array") else F.col(attribute).isin(*values))


def accessible(edges: DataFrame, predicates: Sequence[Column], missing_accessible: bool = True) -> DataFrame:
    """Edges that all predicates allow; where one is null, by default it allows."""
    keep = F.lit(True)
    for p in predicates:
        keep = keep & F.coalesce(p, F.lit(missing_accessible))
    return edges.where(keep)


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    at = nodes.where("node is not null and x is not null and y is not null").groupBy("node").agg(F.min(F.struct("x", "y")).alias("p"))
    u = at.select(F.col("node").alias("u"), F.col("p").alias("_up"))
    v = at.select(F.col("node").alias("v"), F.col("p").alias("_vp"))
    return edges.join(u, "u", "left").join(v, "v", "left")


def fill_geometries(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A missing geometry becomes the straight line between the nodes; without nodes it stays null."""
    straight = F.when(F.col("_up").isNotNull() & F.col("_vp").isNotNull(), F.array("_up", "_vp"))
    return _ends(edges, nodes).withColumn("geometry", F.coalesce("geometry", straight)).select(*edges.columns)


def correct_direction(edges: DataFrame, nodes: DataFrame, precision: int = 6) -> DataFrame:
    """Geometries turned round that don't begin at node u, to so many decimals."""
    near = 0.5 * 10.0**-precision
    p = F.get("geometry", F.lit(0))
    begins = (F.abs(p["x"] - F.col("_up.x")) < near) & (F.abs(p["y"] - F.col("_up.y")) < near)
    return _ends(edges, nodes).withColumn("geometry", F.when(F.coalesce(~begins, F.lit(False)), F.reverse("geometry")).otherwise(F.col("geometry"))).select(*edges.columns)


def lowest_cost_edge(edges: DataFrame, cost: str) -> DataFrame:
    """``u, v, key`` and cost of the cheapest of parallel edges, of equal ones the lowest key."""
    return edges.groupBy("u", "v").agg(F.min(F.struct(F.col(cost), F.col("key"))).alias("b")).select("u", "v", F.col("b.key").alias("key"), F.col(f"b.{cost}").alias(cost))


def split_self_loops(edges: DataFrame, two_way: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, new nodes): edges from a node to itself in three thirds over two new nodes
    ``<u>_<key>_a`` and ``..._b``, and back again where they aren't one-way."""
    loop = (F.col("u") == F.col("v")) & (F.size("geometry") > 1)
    loops = edges.where(loop)
    total = L.length(F.col("geometry"))
    pieces = L.split_at(F.col("geometry"), F.array(total / 3, total * 2 / 3))
    name = lambda end: F.concat_ws("_", F.col("u").cast("string"), F.col("key").cast("string"), F.lit(end))
    cut = loops.withColumns({"_p": pieces, "_a": name("a"), "_b": name("b")})
    stops = [F.col("u").cast("string"), F.col("_a"), F.col("_b"), F.col("v").cast("string")]
    forth = [F.struct(stops[k].alias("u"), stops[k + 1].alias("v"), F.get("_p", F.lit(k)).alias("g"), F.lit(False).alias("back")) for k in range(3)]
    back = [F.struct(stops[k + 1].alias("u"), stops[k].alias("v"), F.reverse(F.get("_p", F.lit(k))).alias("g"), F.lit(True).alias("back")) for k in range(3)]
    made = cut.select("*", F.explode(F.array(*forth, *(back if two_way else []))).alias("_s")).where(~F.col("_s.back") | ~F.coalesce(F.col("oneway"), F.lit(False)))
    new = made.withColumns({"u": F.col("_s.u"), "v": F.col("_s.v"), "geometry": F.col("_s.g"), "key": F.lit(0).cast(dict(edges.dtypes)["key"])}).withColumn("length", L.length(F.col("geometry")))
    nodes = cut.select(F.explode(F.array(F.struct(F.col("_a").alias("node"), L.last(F.get("_p", F.lit(0))).alias("g")), F.struct(F.col("_b").alias("node"), L.last(F.get("_p", F.lit(1))).alias("g")))).alias("n"))
    return edges.where(~F.coalesce(loop, F.lit(False))).unionByName(new.select(*edges.columns)), nodes.select("n.node", F.col("n.g.x").alias("x"), F.col("n.g.y").alias("y"))


def insert_nodes(edges: DataFrame, splits: DataFrame, key: str = "ord") -> DataFrame:
    """Edges cut at new nodes: ``splits`` has the edge's ``key``, ``place`` along it and ``node``.

    All cuts of an edge are made at once, in order of place and name; attributes
    are copied to the pieces, whose ``piece`` counts from 0 (null on edges left whole).
    """
    cuts = splits.where("place is not null and node is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("place", F.col("node").cast("string").alias("node")))).alias("_cuts"))
    joined = edges.join(cuts, key, "left")
    stops = F.concat(F.array(F.col("u").cast("string")), F.col("_cuts.node"), F.array(F.col("v").cast("string")))
    pieces = joined.where("_cuts is not null").withColumn("_stops", stops).select(
        "*", F.posexplode(L.split_at(F.col("geometry"), F.col("_cuts.place"))).alias("piece", "_g")
    )
    cut = pieces.withColumns({"u": F.get("_stops", F.col("piece")), "v": F.get("_stops", F.col("piece") + 1), "geometry": F.col("_g")}).withColumn("length", L.length(F.col("geometry")))
    return joined.where("_cuts is null").select(*edges.columns, F.lit(None).cast("int").alias("piece")).unionByName(cut.select(*edges.columns, "piece"))


# --- components and chains ------------------------------------------------


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (its least node) of all nodes in ``pairs``.

    Alternating large-star and small-star steps: the number of rounds grows with
    the logarithm of the largest component, and a hub's neighbours are aggregated
    before they are shuffled. Each round is written to the checkpoint folder.
    """
    edges = checkpointed(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct())
    seen = pairs.select(F.col(a).alias("node")).union(pairs.select(F.col(b))).distinct()
    while True:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        after = checkpointed(small)
        same = after.count() == edges.count() and after.join(edges, ["hi", "lo"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return seen.join(edges, seen["node"] == edges["hi"], "left").select("node", F.coalesce("lo", "node").alias("component"))


def nodes_from_edges(edges: DataFrame, order: str, distance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(edges with ``u`` and ``v``, nodes): ends of geometries at most ``distance`` apart become one node.

    Ends are linked through others between them, whatever the order of edges.
    Nodes are numbered from 0 by the first edge, and its first end, that touches
    them, and lie at that end. Equal ends are collapsed before they are compared;
    the rest meet in cells as wide as the distance.
    """
    e = edges.where("size(geometry) > 0")
    end = lambda k, g: F.struct(F.col(order).alias("o"), F.lit(k).alias("k"), g["x"].alias("x"), g["y"].alias("y"))
    ends = e.select(F.explode(F.array(end(0, F.get("geometry", F.lit(0))), end(1, L.last(F.col("geometry"))))).alias("e")).select("e.*")
    places = ends.groupBy("x", "y").agg(F.min(F.struct("o", "k")).alias("first"))
    if distance > 0:
        cell = places.select(F.struct("first", "x", "y").alias("p"), F.floor(F.col("x") / distance).alias("cx"), F.floor(F.col("y") / distance).alias("cy"))
        around = cell.select(F.col("p").alias("q"), F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")).select("q", "c.*")
        close = cell.join(around, ["cx", "cy"]).where((F.col("p.first") <= F.col("q.first")) & (L.distance(F.col("p"), F.col("q")) <= distance))
        label = components(close.select(F.col("p.first").alias("a"), F.col("q.first").alias("b")), "a", "b").select(F.col("node").alias("first"), F.col("component"))
        placed = places.join(label, "first")
    else:
        placed = places.withColumn("component", F.col("first"))
    placed = checkpointed(placed)
    heads = placed.where(F.col("first") == F.col("component")).select("component", "x", "y")
    numbered = checkpointed(_dense_numbers(heads, "component", "node"))
    named = placed.join(numbered.select("component", "node"), "component").select("x", "y", "node")
    out = e
    for name, g in (("u", F.get("geometry", F.lit(0))), ("v", L.last(F.col("geometry")))):
        own = named.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("node").alias(name))
        out = out.drop(name).join(own, (g["x"] == F.col("_x")) & (g["y"] == F.col("_y"))).drop("_x", "_y")
    return out, numbered.select("node", "x", "y")


def _dense_numbers(df: DataFrame, by: str, name: str) -> DataFrame:
    """``name``: 0, 1, 2, ... in order, without bringing all rows together: sorted ranges, each with its offset."""
    ranged = checkpointed(df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()))
    offsets = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    return ranged.withColumn("_k", within).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_n", "_before", "_k")


def chain_labels(edges: DataFrame, key: str = "ord") -> DataFrame:
    """``key, head, place`` of each directed edge: the chain's first edge and the place along it from 0.

    A node passes edges through if it has two neighbours and two or four edge
    ends, no loop, and both an edge in and an edge out. Chains are ranked by
    pointer doubling, a number of rounds that grows with the logarithm of the
    longest; rings without any other node stay single edges.
    """
    e = checkpointed(edges.select(F.col(key).alias("e"), "u", "v").where("u is not null and v is not null"))
    ends = e.select(F.col("u").alias("n"), F.col("v").alias("m"), F.lit(1).alias("out")).union(e.select(F.col("v"), F.col("u"), F.lit(0)))
    inner = ends.groupBy("n").agg(F.count("*").alias("d"), F.sum("out").alias("o"), F.max((F.col("n") == F.col("m")).cast("int")).alias("loop"), F.min("m").alias("a"), F.max("m").alias("b"), F.count_distinct("m").alias("k")).where("k = 2 and d in (2, 4) and loop = 0 and o > 0 and o < d").select("n", "d")
    into = e.join(inner, e["v"] == inner["n"]).select(F.col("e").alias("before"), F.col("u").alias("from"), F.col("n"))
    link = e.join(into, e["u"] == into["n"]).where(F.col("from") != F.col("v")).groupBy("e").agg(F.min("before").alias("before"), F.count("*").alias("c")).where("c = 1").select("e", "before")
    state = checkpointed(e.join(link, "e", "left").select("e", F.coalesce("before", "e").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("place"), F.col("before").isNull().alias("done")))
    waiting = state.where("not done").count()
    for _ in range(MAX_DOUBLINGS):
        if not waiting:
            break
        ahead = state.select(F.col("e").alias("head"), F.col("head").alias("h2"), F.col("place").alias("p2"), F.col("done").alias("d2"))
        moved = state.join(ahead, "head").select("e", F.when(F.col("done"), F.col("head")).otherwise(F.col("h2")).alias("head"), F.when(F.col("done"), F.col("place")).otherwise(F.col("place") + F.col("p2")).alias("place"), (F.col("done") | F.col("d2")).alias("done"))
        state = checkpointed(moved)
        left = state.where("not done").count()
        if left == waiting:  # what is left goes round in rings
            break
        waiting = left
    return state.select(F.col("e").alias(key), F.when(F.col("done"), F.col("head")).otherwise(F.col("e")).alias("head"), F.when(F.col("done"), F.col("place")).otherwise(F.lit(0)).alias("place"))


def contract_chains(edges: DataFrame, key: str = "ord", attributes: Sequence[str] = ()) -> DataFrame:
    """``u, v, key, geometry, length, edges`` and, for each attribute, the set of its values: each chain as one edge.

    A chain takes the key of its first edge. Null geometries and lengths in a
    chain are passed over; chains of nulls alone stay null.
    """
    rows = edges.join(chain_labels(edges, key), key)
    own = F.struct("place", "u", "v", "geometry", "length")
    chained = rows.groupBy("head").agg(F.array_sort(F.collect_list(own)).alias("c"), *[F.array_sort(F.collect_set(a)).alias(a) for a in attributes])
    known = F.filter(F.col("c.geometry"), lambda g: g.isNotNull())
    lengths = F.filter(F.col("c.length"), lambda x: x.isNotNull())
    return chained.select(
        F.get("c", F.lit(0))["u"].alias("u"), F.element_at("c", -1)["v"].alias("v"), F.col("head").alias(key),
        F.when(F.size(known) > 0, L.merge_ordered(known)).alias("geometry"),
        F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x)).alias("length"), F.size("c").alias("edges"), *attributes,
    )
