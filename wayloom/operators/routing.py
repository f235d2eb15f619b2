"""Shortest paths, routes and what they pass."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.staged import spread
from wayloom.session import checkpointed

#: Bytes up to which every worker holds the whole network (two numbers and a cost an edge, and each node's name); beyond that paths spread over tables.
MAX_BROADCAST_BYTES = 64 << 20


def _network(edges: DataFrame, cost: str) -> DataFrame:
    return edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col(cost).isNotNull() & (F.col(cost) >= 0) & ~F.isnan(F.col(cost).cast("double"))).groupBy(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")).agg(F.min(F.col(cost).cast("double")).alias("w"))


class _Graph:
    """Adjacency in arrays over numbered nodes, whose numbers follow their names, so that ties go to the lesser name."""

    def __init__(self, names: pa.Array, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        self.names = names
        self.numbers = {n: k for k, n in enumerate(names.to_pylist())}
        order = np.lexsort((v, u))
        # lists, for a search asks for one number after another; each node's neighbours lie together
        self.to, self.w = v[order].tolist(), w[order].tolist()
        self.start = np.searchsorted(u[order], np.arange(len(names) + 1)).tolist()

    @staticmethod
    def packed(net: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(names in order, from, to, cost) of a table ``u, v, w``."""
        both = pa.concat_arrays([net.column(n).combine_chunks() for n in ("u", "v")])
        coded = both.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        code = rank[coded.indices.to_numpy(zero_copy_only=False)]
        return coded.dictionary.take(pa.array(order)), code[: net.num_rows], code[net.num_rows :], net.column("w").to_numpy()

    def number(self, name: str) -> int | None:
        return self.numbers.get(name)

    def paths(self, origin: int, wanted: set[int], routes: bool = True) -> dict[int, tuple[float, list[int] | int]]:
        """Cost and nodes (or only their number) to each wanted node that can be reached."""
        to, w, start = self.to, self.w, self.start
        best, before, settled, out = {origin: (0.0, 0)}, {origin: -1}, set(), {}
        heap = [(0.0, 0, origin)]
        left = set(wanted)
        while heap and left:
            d, hops, n = heapq.heappop(heap)
            if n in settled:
                continue
            settled.add(n)
            if n in left:
                left.discard(n)
                if routes:
                    route, at = [], n
                    while at != -1:
                        route.append(at)
                        at = before[at]
                    out[n] = d, route[::-1]
                else:
                    out[n] = d, hops + 1
            hops += 1
            for k in range(start[n], start[n + 1]):
                m = to[k]
                if m in settled:
                    continue
                c, known = (d + w[k], hops), best.get(m)
                if known is None or c < known:
                    best[m], before[m] = c, n
                    heapq.heappush(heap, (*c, m))
                elif c == known and n < before[m]:
                    before[m] = n
        return out


def by_origin(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Each origin once with all its destinations, of rows in order of the origin: a batch may end within one."""
    origin, waiting = None, []
    for batch in batches:
        for o, d in zip(batch.column("origin").to_pylist(), batch.column("destination").to_pylist()):
            if o != origin:
                if waiting:
                    yield origin, waiting
                origin, waiting = o, []
            waiting.append(d)
    if waiting:
        yield origin, waiting


def shortest_paths(pairs: DataFrame, edges: DataFrame, cost: str = "length", max_broadcast: int = MAX_BROADCAST_BYTES, routes: bool = True) -> DataFrame:
    """``origin, destination, cost, route`` (the nodes as array<string>) of each distinct pair; both null where there is no way.

    Without ``routes`` it has ``steps`` instead, the number of the route's nodes: routes to all nodes of a network together are far larger than it.

    A pair of equal nodes costs 0. Edges without cost or with a negative one
    aren't used; of parallel ones the cheapest is. Of equally cheap routes the
    one of fewest nodes is chosen, then from its end the lesser names. Up to ``max_broadcast`` bytes, added
    up first, every worker holds the network and searches from each of its origins
    once; beyond, costs spread round by round over tables, with the same result.
    """
    wanted = pairs.select(F.col("origin").cast("string").alias("origin"), F.col("destination").cast("string").alias("destination")).where("origin is not null and destination is not null").distinct()
    net = _network(edges, cost)
    net = checkpointed(net)
    # at most the names of both ends of every edge, for names are held once a node
    size = net.agg(F.sum(F.octet_length("u") + F.octet_length("v") + 24).alias("n")).first()["n"] or 0
    if size > max_broadcast:
        return _spread_paths(wanted, net, routes)
    shared = pairs.sparkSession.sparkContext.broadcast(_Graph.packed(net.toArrow()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, out = None, []
        for o, ds in by_origin(batches):
            graph = graph or _Graph(*shared.value)
            codes = {d: graph.number(d) for d in ds}
            start = graph.number(o)
            found = graph.paths(start, {c for c in codes.values() if c is not None}, routes) if start is not None else {}
            for d in ds:
                if d == o:
                    out.append((o, d, 0.0, [o] if routes else 1))
                elif codes[d] in found and codes[d] is not None:
                    c, route = found[codes[d]]
                    out.append((o, d, c, graph.names.take(pa.array(route)).to_pylist() if routes else route))
                else:
                    out.append((o, d, None, None))
                if len(out) >= 1_000:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["origin", "destination", "cost", "route" if routes else "steps"])

    kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()) if routes else pa.int32())
    return spread(wanted, "origin").sortWithinPartitions("origin").mapInArrow(search, "origin string, destination string, cost double, " + ("route array<string>" if routes else "steps int"))


def path_costs(sources: DataFrame, net: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``source, node, cost, before, hop`` (its steps) of every node that each source reaches, over tables.

    With ``wanted`` (``source, node``) a source's costs spread no farther than
    the farthest of its wanted nodes as known so far, once all of them are known;
    what lies beyond can't be on the way to any.

    Costs spread from the nodes that improved in the last round, all sources at
    once; every round is one join and one aggregate, written to the checkpoint
    folder. Then nodes are reached anew, by the edges that keep to these costs
    only: a node's round is the number of its steps, so edges without cost can't
    make a circle of ``before``. ``net`` has ``u, v, w``.
    """
    start = checkpointed(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("before")))
    best = frontier = start.drop("before")
    while True:
        offers = frontier.join(net, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost")).groupBy("source", "node").agg(F.min("cost").alias("o"))
        joined = checkpointed(best.join(offers, ["source", "node"], "full_outer"))
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o") < F.col("cost")))
        frontier = joined.where(better).select("source", "node", F.col("o").alias("cost"))
        best = joined.select("source", "node", F.when(better, F.col("o")).otherwise(F.col("cost")).alias("cost"))
        if wanted is not None:
            reached = wanted.join(best, ["source", "node"], "left").groupBy("source").agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("far"))
            frontier = checkpointed(frontier.join(reached, "source").where(F.col("cost") <= F.col("far")).drop("far"))
        if frontier.isEmpty():
            break
    ends = best.select("source", F.col("node").alias("v"), F.col("cost").alias("_c"))
    kept = best.join(net, F.col("node") == F.col("u")).select("source", "u", "v", (F.col("cost") + F.col("w")).alias("_c")).join(ends, ["source", "v", "_c"])
    kept = checkpointed(kept.withColumnRenamed("_c", "cost"))
    tree, hop = start.withColumn("hop", F.lit(0)), 0
    while True:
        reached = tree.where(F.col("hop") == hop).select("source", F.col("node").alias("u")).join(kept, ["source", "u"]).groupBy("source", F.col("v").alias("node")).agg(F.struct(F.min("cost").alias("cost"), F.min("u").alias("before"), F.lit(hop + 1).alias("hop")).alias("o"))
        own = F.struct("cost", "before", "hop")
        tree = checkpointed(tree.select("source", "node", own.alias("t")).join(reached, ["source", "node"], "full_outer").select("source", "node", F.coalesce("t", "o").alias("t")).select("source", "node", "t.*"))
        hop += 1
        if tree.where(F.col("hop") == hop).isEmpty():
            return tree


def _spread_paths(wanted: DataFrame, net: DataFrame, routes: bool = True) -> DataFrame:
    targets = checkpointed(wanted.select(F.col("origin").alias("source"), F.col("destination").alias("node")))
    tree = checkpointed(path_costs(targets.select("source").distinct(), net, targets))
    if not routes:
        return wanted.join(tree.select(F.col("source").alias("origin"), F.col("node").alias("destination"), "cost", (F.col("hop") + 1).alias("steps")), ["origin", "destination"], "left")
    route = checkpointed(wanted.join(tree.select(F.col("source").alias("origin"), F.col("node").alias("destination"), "cost", "before"), ["origin", "destination"], "left").withColumn("route", F.when(F.col("cost").isNotNull(), F.array("destination"))).withColumn("at", F.col("before")))
    while not route.where("at is not null").isEmpty():
        step = tree.select(F.col("source").alias("origin"), F.col("node").alias("at"), F.col("before").alias("next"))
        route = checkpointed(route.join(step, ["origin", "at"], "left").select("origin", "destination", "cost", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "route")).otherwise(F.col("route")).alias("route"), F.col("next").alias("at")))
    return route.select("origin", "destination", "cost", "route")


def cheapest_of_sets(groups: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """``pair, origin, destination, cost, route``: the cheapest way between any of several origins and destinations.

    ``groups`` has ``pair, origins array, destinations array``, as where nodes are
    split into the ends of their turns. Pairs without any way have none.
    """
    every = groups.select("pair", F.explode("origins").alias("origin"), "destinations").select("pair", "origin", F.explode("destinations").alias("destination"))
    every = every.select("pair", F.col("origin").cast("string").alias("origin"), F.col("destination").cast("string").alias("destination"))
    found = every.join(shortest_paths(every, edges, cost), ["origin", "destination"]).where("cost is not null")
    return found.groupBy("pair").agg(F.min(F.struct("cost", "origin", "destination", "route")).alias("b")).select("pair", "b.origin", "b.destination", "b.cost", "b.route")


def route_pairs(routes: DataFrame, route_id: str = "route_id", route: str = "route") -> DataFrame:
    """``route_id, seq, u, v`` of each step, from 0; routes of fewer than two nodes have none."""
    g = F.col(route)
    steps = F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    return routes.where(g.isNotNull()).select(route_id, F.posexplode(steps).alias("seq", "s")).select(route_id, "seq", "s.u", "s.v")


def route_edges(routes: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """Each step of the routes with the cheapest of its parallel edges, of equal ones the lowest key."""
    own = [c for c in edges.columns if c not in ("u", "v")]
    cheapest = edges.groupBy("u", "v").agg(F.min(F.struct(F.col(cost).alias("_c"), F.col("key").alias("_k"), *own)).alias("b")).select("u", "v", *[F.col(f"b.{c}").alias(c) for c in own])
    return route_pairs(routes).join(cheapest, ["u", "v"], "left")


def summarize_routes(routes: DataFrame, edges: DataFrame, summaries: dict[str, Column] | None = None, cost: str = "length") -> DataFrame:
    """``route_id``, ``route_length`` (infinite without a way), ``steps``, ``geometry`` (the lines in order) and further aggregates by name."""
    steps = route_edges(routes, edges, cost)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "geometry"))), lambda s: s["geometry"])
    made = steps.groupBy("route_id").agg(F.sum("length").alias("route_length"), F.count("*").alias("steps"), lines.alias("geometry"), *[c.alias(n) for n, c in (summaries or {}).items()])
    out = routes.select("route_id").join(made, "route_id", "left")
    return out.withColumns({"route_length": F.coalesce("route_length", F.lit(float("inf"))), "steps": F.coalesce("steps", F.lit(0))})


def count_along_edges(routes: DataFrame, edges: DataFrame, keep_all: bool = False) -> DataFrame:
    """Edges with ``route_count``, how often routes pass from u to v; with ``keep_all`` also those no route passes (null)
    and steps without an edge."""
    counts = route_pairs(routes).groupBy("u", "v").agg(F.count("*").alias("route_count"))
    return edges.join(counts, ["u", "v"], "full_outer" if keep_all else "inner")


def nearest_poi_routes(net: DataFrame, edges: DataFrame, count: int, cost: str = "length") -> DataFrame:
    """``node, rank, poi, cost, route`` from a wide table ``node, poi_1 ... poi_n``; missing places have no row."""
    long = net.select("node", F.posexplode(F.array(*[F.col(f"poi_{k}") for k in range(1, count + 1)])).alias("rank", "poi")).where("poi is not null")
    pairs = long.select(F.col("node").cast("string").alias("origin"), F.col("poi").cast("string").alias("destination"))
    found = shortest_paths(pairs, edges, cost)
    return long.withColumn("rank", F.col("rank") + 1).join(found, (F.col("node").cast("string") == found["origin"]) & (F.col("poi").cast("string") == found["destination"])).select("node", "rank", "poi", "cost", "route")
