"""Queries of the operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.functions import shapes
from wayloom.functions.let import point
from wayloom.operators import network, reshape, routing, spatial
from wayloom.plans.conflate import _matches, _targets
from wayloom.plans.network import _E, _edges, _nation_net
from wayloom.plans.tables import r, table
from wayloom.sources import tables

QUERIES, SQL = {}, {}
c = F.col

QUERIES["nearest_feature_hausdorff"] = lambda spark, sf_dir: spatial.nearest_feature(_targets(spark, sf_dir), _matches(spark, sf_dir), 20.0, hausdorff=True).select("left_id", "line_id", r(c("distance"), "distance", 3))
QUERIES["accessible_edges"] = lambda spark, sf_dir: network.accessible(_edges(spark, sf_dir), [c("length") < 120, c("edge_level") <= 3]).select("ord")
SQL["accessible_edges"] = f"WITH {_E} SELECT ord FROM e WHERE coalesce(length < 120, true) AND coalesce(edge_level <= 3, true)"
QUERIES["edges_to_digraph"] = lambda spark, sf_dir: network.edges_to_digraph(_edges(spark, sf_dir), "ord").select("u", "v", "key", "ord")
SQL["edges_to_digraph"] = f"WITH {_E} SELECT u, v, key, ord FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY ord DESC) n FROM e) WHERE n = 1"
QUERIES["remove_edges"] = lambda spark, sf_dir: network.remove_edges(_edges(spark, sf_dir), _edges(spark, sf_dir).where("edge_level = 2")).select("ord")
SQL["remove_edges"] = f"WITH {_E} SELECT ord FROM e WHERE NOT coalesce(edge_level = 2, false)"
QUERIES["cheapest_of_sets"] = lambda spark, sf_dir: (
    routing.cheapest_of_sets(spark.range(3).select(c("id").alias("pair"), F.array(F.lit("0"), F.lit("1")).alias("origins"), F.array((c("id") + 20).cast("string"), (c("id") + 12).cast("string")).alias("destinations")), _nation_net(spark, sf_dir)).select("pair", "cost")
)
SQL["cheapest_of_sets"] = """WITH RECURSIVE n AS (SELECT a.n_nationkey u, b.n_nationkey v, (7*a.n_nationkey+13*b.n_nationkey)%17+1 w FROM nation a JOIN nation b ON b.n_nationkey-a.n_nationkey IN (1,5,7)),
 p AS (SELECT s node, 0 cost FROM (VALUES (0),(1)) t(s) UNION ALL SELECT v, cost+w FROM p JOIN n ON node=u), b AS (SELECT node, min(cost) cost FROM p GROUP BY node)
 SELECT CAST(k AS BIGINT) AS pair, CAST(min(cost) AS DOUBLE) AS cost FROM b, range(0,3) t(k) WHERE node IN (k+20, k+12) GROUP BY k"""
QUERIES["poi_routes"] = lambda spark, sf_dir: (
    routing.nearest_poi_routes(table(spark, sf_dir, "nation").select(c("n_nationkey").cast("bigint").alias("node"), (c("n_nationkey") + 1).cast("bigint").alias("poi_1"), F.when(c("n_nationkey") % 2 == 0, c("n_nationkey") + 7).cast("bigint").alias("poi_2")), _nation_net(spark, sf_dir), 2).where("cost is not null").select("node", "rank", "poi", "cost")
)
SQL["poi_routes"] = """WITH RECURSIVE n AS (SELECT a.n_nationkey u, b.n_nationkey v, (7*a.n_nationkey+13*b.n_nationkey)%17+1 w FROM nation a JOIN nation b ON b.n_nationkey-a.n_nationkey IN (1,5,7)),
 p AS (SELECT n_nationkey a, n_nationkey z, 0 cost FROM nation UNION SELECT a, v, cost+w FROM p JOIN n ON z=u WHERE v-a<=7), b AS (SELECT a, z, min(cost) cost FROM p GROUP BY a, z),
 k AS (SELECT n_nationkey node, 1 AS rank, n_nationkey+1 poi FROM nation UNION ALL SELECT n_nationkey, 2, n_nationkey+7 FROM nation WHERE n_nationkey%2=0)
 SELECT CAST(node AS BIGINT) node, rank, CAST(poi AS BIGINT) poi, CAST(cost AS DOUBLE) AS cost FROM k JOIN b ON a=node AND z=poi"""
QUERIES["route_steps"] = lambda spark, sf_dir: routing.route_pairs(_edges(spark, sf_dir).select(c("ord").alias("route_id"), F.array("u", "v", "u").alias("route")))
SQL["route_steps"] = f"WITH {_E} SELECT ord route_id, 0 seq, u, v FROM e UNION ALL SELECT ord, 1, v, u FROM e"
QUERIES["random_points_inside"] = lambda spark, sf_dir: (
    P.random_points(spark.range(1).select(F.array(F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (100.0, 99.9), (100.0, 100.0), (0.0, 0.1))])).alias("geometry")), 200)
    .select(((c("y") >= c("x") * 0.999 - 1e-9) & (c("y") <= 0.1 + c("x") * 0.999 + 1e-9)).alias("inside")).groupBy("inside").agg(F.count("*").alias("points"))
)
SQL["random_points_inside"] = "SELECT true AS inside, CAST(200 AS BIGINT) AS points"
QUERIES["random_points"] = lambda spark, sf_dir: P.random_points(spark.range(1).select(P.rectangle(0, 0, 10, 10).alias("geometry")), 100)
QUERIES["single_parts"] = lambda spark, sf_dir: reshape.single_parts(table(spark, sf_dir, "buildings").select("id", "geometry").distinct()).select("id", "part", F.size("geometry").alias("vertices"))
SQL["single_parts"] = "SELECT id, CAST(k-1 AS INT) AS part, CAST(len(g[k]) AS INT) AS vertices FROM (SELECT id, g, unnest(range(1,len(g)+1)) k FROM (SELECT DISTINCT id, geometry g FROM buildings WHERE geometry IS NOT NULL))"
QUERIES["valid_geometries"] = lambda spark, sf_dir: reshape.valid_geometries(table(spark, sf_dir, "edges")).select("ord")
SQL["valid_geometries"] = "SELECT ord FROM edges WHERE len(geometry) > 0"
QUERIES["move_columns"] = lambda spark, sf_dir: tables.rename_geometry(reshape.first_column(table(spark, sf_dir, "nation"), "n_regionkey").withColumnRenamed("n_name", "shape"), "shape")
SQL["move_columns"] = "SELECT n_regionkey, n_nationkey, n_name AS geometry FROM nation"
QUERIES["merge_multiline"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 1").select("ord", shapes.merge_multiline(F.array(F.slice("geometry", F.lit(2), F.size("geometry")), F.reverse(F.slice("geometry", 1, 2))), 0.01).alias("m")).select("ord", F.size("m").alias("lines"), F.size(c("m")[0]).alias("vertices"))
)
QUERIES["find_parallel"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 2").select("ord", L.parallel_part(F.array(F.get("geometry", F.lit(1)), F.struct((F.get("geometry", F.lit(1))["x"] + 1).alias("x"), F.get("geometry", F.lit(1))["y"].alias("y"))), c("geometry")).alias("p")).select("ord", r(L.length(c("p")), "length", 3)).where("length is not null")
)
QUERIES["line_segment_between"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 1").select("ord", L.segment_between(c("geometry"), L.last(c("geometry")), L.first(c("geometry"))).alias("s")).select("ord", r(L.first(c("s"))["x"], "x", 3))
)
SQL["line_segment_between"] = "SELECT ord, round(geometry[-1].x,3)+0.0 AS x FROM edges WHERE len(geometry) > 1"
