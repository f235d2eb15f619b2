"""Queries of spatial joins and area functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.functions import shapes
from wayloom.functions.let import point
from wayloom.operators import spatial
from wayloom.plans.tables import r, table

QUERIES, SQL = {}, {}
c = F.col


def _customers(spark, sf_dir):
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 1013).cast("double").alias("y"), "c_nationkey", "c_acctbal")


def _suppliers(spark, sf_dir):
    k = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 6007 % 1009).cast("double").alias("x"), (k * 3571 % 1013).cast("double").alias("y"), "s_acctbal")


def _rectangles(spark, sf_dir):
    k = c("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 1013).cast("double").alias("y"), c("p_size").cast("double").alias("w"), (1 + k % 25).cast("double").alias("h"), "p_retailprice")
    return p.withColumn("geometry", P.rectangle(c("x"), c("y"), c("x") + c("w"), c("y") + c("h")))


def _zones(spark, sf_dir):
    """Squares of 100 around the suppliers' positions."""
    return _suppliers(spark, sf_dir).withColumn("geometry", P.rectangle(c("x"), c("y"), c("x") + 100, c("y") + 100))


_PTS = """cu AS (SELECT c_custkey id, (c_custkey*7919)%1009 x, (c_custkey*104729)%1013 y, c_nationkey FROM customer),
 su AS (SELECT s_suppkey id, (s_suppkey*6007)%1009 x, (s_suppkey*3571)%1013 y, s_acctbal FROM supplier),
 re AS (SELECT p_partkey id, (p_partkey*7919)%1009 x, (p_partkey*104729)%1013 y, p_size::DOUBLE w, (1+p_partkey%25)::DOUBLE h, p_retailprice FROM part)"""
_KNN = f"""{_PTS}, d AS (SELECT cu.id a_id, su.id b_id, sqrt(pow(cu.x-su.x,2)+pow(cu.y-su.y,2)) d FROM cu, su),
 k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) rank FROM d)"""


def nearest_supplier(spark, sf_dir):
    """Each customer's nearest supplier."""
    return spatial.nearest_points(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 1, 64.0).select("a_id", "b_id", r(c("distance"), "distance"))


QUERIES["nearest_supplier"] = nearest_supplier
SQL["nearest_supplier"] = f"WITH {_KNN} SELECT a_id, b_id, round(d,4)+0.0 AS distance FROM k WHERE rank = 1"
QUERIES["knn_supplier_k3"] = lambda spark, sf_dir: spatial.nearest_points(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 3, 64.0).select("a_id", "b_id", "rank", r(c("distance"), "distance"))
SQL["knn_supplier_k3"] = f"WITH {_KNN} SELECT a_id, b_id, CAST(rank AS INT) AS rank, round(d,4)+0.0 AS distance FROM k WHERE rank <= 3"
QUERIES["nearest_dist_int"] = lambda spark, sf_dir: spatial.nearest_points(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 1, 64.0).select("a_id", c("distance").cast("bigint").alias("distance"))
SQL["nearest_dist_int"] = f"WITH {_KNN} SELECT a_id, CAST(floor(d) AS BIGINT) AS distance FROM k WHERE rank = 1"
QUERIES["points_within"] = lambda spark, sf_dir: spatial.points_within(_customers(spark, sf_dir), _suppliers(spark, sf_dir), 25.0).select("a_id", "b_id", r(c("distance"), "distance"))
SQL["points_within"] = f"WITH {_KNN} SELECT a_id, b_id, round(d,4)+0.0 AS distance FROM d WHERE d <= 25"
QUERIES["points_in_rect_count"] = lambda spark, sf_dir: spatial.count_points_in_polygons(_customers(spark, sf_dir), _rectangles(spark, sf_dir), 64.0).select("id", "count")
SQL["points_in_rect_count"] = f"""WITH {_PTS}, n AS (SELECT re.id, count(*) n FROM re JOIN cu ON cu.x>=re.x AND cu.x<re.x+w AND cu.y>=re.y AND cu.y<re.y+h GROUP BY re.id)
 SELECT re.id, n AS "count" FROM re LEFT JOIN n USING (id)"""
QUERIES["semi_points_in_polygon"] = lambda spark, sf_dir: (
    spatial.within_polygon(_customers(spark, sf_dir), spark.range(1).select(F.array(F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((100.5, 100.5), (700.5, 200.5), (400.5, 900.5))])).alias("geometry")), point(c("x"), c("y"))).select("id")
)
SQL["semi_points_in_polygon"] = f"""WITH {_PTS} SELECT id FROM cu WHERE (700.5-100.5)*(y-100.5)-(200.5-100.5)*(x-100.5) > 0
 AND (400.5-700.5)*(y-200.5)-(900.5-200.5)*(x-700.5) > 0 AND (100.5-400.5)*(y-900.5)-(100.5-900.5)*(x-400.5) > 0"""
QUERIES["point_attrs_to_nodes"] = lambda spark, sf_dir: (
    spatial.attach_nearest_attributes(_customers(spark, sf_dir).withColumnRenamed("id", "node"), _suppliers(spark, sf_dir), 40.0, ["s_acctbal"]).select("node", "s_acctbal")
)
SQL["point_attrs_to_nodes"] = f"WITH {_KNN} SELECT cu.id node, s_acctbal FROM cu LEFT JOIN (SELECT a_id, s_acctbal FROM k JOIN su ON su.id=b_id WHERE rank=1 AND d<=40) n ON n.a_id=cu.id"
for kind, sql in {"extensive": "sum(p_retailprice*s/(w*h))", "intensive": "sum(p_retailprice*s)/sum(s)"}.items():
    QUERIES[f"rect_area_weighted_{kind}"] = lambda spark, sf_dir, kind=kind: (
        spatial.area_weighted(_rectangles(spark, sf_dir), _zones(spark, sf_dir), 128.0, **{kind: ["p_retailprice"]}, rectangles=True).select("id", r(c("p_retailprice"), "value", 3))
    )
    SQL[f"rect_area_weighted_{kind}"] = f"""WITH {_PTS}, o AS (SELECT su.id, p_retailprice, w, h, greatest(0.0,least(su.x+100.0,re.x+w)-greatest(su.x,re.x)) * greatest(0.0,least(su.y+100.0,re.y+h)-greatest(su.y,re.y)) s FROM su, re),
 v AS (SELECT id, {sql} v FROM o WHERE s>0 GROUP BY id) SELECT su.id, round(v,3)+0.0 AS value FROM su LEFT JOIN v USING (id)"""
QUERIES["area_weighted_shapes"] = lambda spark, sf_dir: (
    spatial.area_weighted(_rectangles(spark, sf_dir), _zones(spark, sf_dir), 128.0, extensive=["p_retailprice"]).select("id", r(c("p_retailprice"), "value", 3))
)
SQL["area_weighted_shapes"] = SQL["rect_area_weighted_extensive"]


def _buildings(spark, sf_dir):
    return table(spark, sf_dir, "buildings").select("id", "geometry").where("geometry is not null").distinct()


_B = "b AS (SELECT DISTINCT id, geometry g FROM buildings WHERE geometry IS NOT NULL), q AS (SELECT id, k, g[k] ring FROM (SELECT id, g, unnest(range(1,len(g)+1)) k FROM b)), c AS (SELECT id, k, CASE WHEN ring[1].x=ring[-1].x AND ring[1].y=ring[-1].y THEN ring ELSE list_append(ring, ring[1]) END r FROM q), a AS (SELECT id, k, abs(list_sum(list_transform(range(1,len(r)), lambda i: (r[i].x-r[1].x)*(r[i+1].y-r[1].y)-(r[i+1].x-r[1].x)*(r[i].y-r[1].y)))/2) a FROM c)"
QUERIES["polygon_area"] = lambda spark, sf_dir: _buildings(spark, sf_dir).select("id", r(P.area(c("geometry")), "area", 3))
SQL["polygon_area"] = f"WITH {_B} SELECT id, round(sum(CASE WHEN k=1 THEN a ELSE -a END),3)+0.0 AS area FROM a GROUP BY id"
QUERIES["polygon_bounds"] = lambda spark, sf_dir: _buildings(spark, sf_dir).select("id", P.bounds(F.get("geometry", F.lit(0))).alias("b")).select("id", "b.*")
SQL["polygon_bounds"] = "SELECT DISTINCT id, list_min(list_transform(geometry[1], lambda p: p.x)) minx, list_min(list_transform(geometry[1], lambda p: p.y)) miny, list_max(list_transform(geometry[1], lambda p: p.x)) maxx, list_max(list_transform(geometry[1], lambda p: p.y)) maxy FROM buildings WHERE geometry IS NOT NULL"
QUERIES["polygon_centroid"] = lambda spark, sf_dir: _rectangles(spark, sf_dir).select("id", P.centroid(c("geometry")).alias("p")).select("id", r(c("p.x"), "x", 3), r(c("p.y"), "y", 3))
SQL["polygon_centroid"] = f"WITH {_PTS} SELECT id, round(x+w/2,3)+0.0 AS x, round(y+h/2,3)+0.0 AS y FROM re"
QUERIES["building_axes"] = lambda spark, sf_dir: _buildings(spark, sf_dir).select("id", r(shapes.major_axis_azimuth(F.get("geometry", F.lit(0))), "azimuth", 3))
QUERIES["total_bounds"] = lambda spark, sf_dir: spatial.total_bounds(table(spark, sf_dir, "edges"), c("geometry"))
SQL["total_bounds"] = "SELECT min(p.x) minx, min(p.y) miny, max(p.x) maxx, max(p.y) maxy FROM (SELECT unnest(geometry) p FROM edges)"
QUERIES["hex_grid"] = lambda spark, sf_dir: P.hexagon_grid(spatial.total_bounds(table(spark, sf_dir, "edges"), c("geometry")), 250.0).select("row", "col", r(c("geometry")[0][0]["x"], "x", 3), r(c("geometry")[0][2]["y"], "y", 3))
SQL["hex_grid"] = """WITH b AS (SELECT min(p.x) x0, min(p.y) y0, max(p.x) x1, max(p.y) y1 FROM (SELECT unnest(geometry) p FROM edges)), k AS (SELECT *, 500*tan(pi()/6) s FROM b),
 m AS (SELECT *, 2*s*cos(radians(30)) w, 2*s h FROM k), r AS (SELECT *, unnest(range(0, CAST(ceil((y1-y0+2*h)/(1.5*s)) AS BIGINT))) rr FROM m),
 q AS (SELECT *, unnest(range(0, CAST(ceil((x1-x0+2*w-CASE WHEN rr%2=1 THEN w/2 ELSE 0 END)/w) AS BIGINT))) cc FROM r)
 SELECT CAST(rr AS INT) AS "row", CAST(cc AS INT) AS col, round(x0-w+CASE WHEN rr%2=1 THEN w/2 ELSE 0 END+cc*w,3)+0.0 AS x, round(y0-h+rr*1.5*s+h,3)+0.0 AS y FROM q"""
QUERIES["quadrat_cut"] = lambda spark, sf_dir: _rectangles(spark, sf_dir).select("id", F.inline(shapes.quadrats(c("geometry"), 20.0))).select("id", "col", "row", r(P.area(c("geometry")), "area", 3))
SQL["quadrat_cut"] = f"""WITH {_PTS}, c AS (SELECT *, unnest(range(CAST(floor(x/20) AS BIGINT), CAST(floor((x+w)/20) AS BIGINT)+1)) col FROM re), q AS (SELECT *, unnest(range(CAST(floor(y/20) AS BIGINT), CAST(floor((y+h)/20) AS BIGINT)+1)) rw FROM c)
 SELECT id, CAST(col AS INT) AS col, CAST(rw AS INT) AS "row", round((least(x+w,col*20+20)-greatest(x,col*20))*(least(y+h,rw*20+20)-greatest(y,rw*20)),3)+0.0 AS area FROM q
 WHERE (least(x+w,col*20+20)-greatest(x,col*20))*(least(y+h,rw*20+20)-greatest(y,rw*20)) > 0"""


def _zone_lines(spark, sf_dir):
    return _customers(spark, sf_dir).select("id", F.array(point(c("x"), c("y")), point(c("x") + 90.25, c("y") + 0.5)).alias("geometry"))


_HZ = f"""{_PTS}, o AS (SELECT cu.id line_id, su.id polygon_id, greatest(cu.x,su.x)-cu.x lo, least(cu.x+90.25,su.x+100.0)-cu.x hi, cu.y y, su.y sy FROM cu, su),
 z AS (SELECT *, greatest(lo, CASE WHEN y < sy THEN (sy-y)*90.25/0.5 ELSE lo END) l2, least(hi, CASE WHEN y+0.5*hi/90.25 > sy+100 THEN (sy+100-y)*90.25/0.5 ELSE hi END) h2 FROM o WHERE y+0.5 >= sy AND y <= sy+100)"""
QUERIES["lines_in_polygons"] = lambda spark, sf_dir: (
    spatial.lines_in_polygons(_zone_lines(spark, sf_dir), _zones(spark, sf_dir), 128.0, give="length").select("line_id", "polygon_id", "part", r(c("length"), "length", 3)).where("length > 0.001")
)
SQL["lines_in_polygons"] = f"WITH {_HZ} SELECT line_id, polygon_id, 0 AS part, round((h2-l2)*sqrt(1+pow(0.5/90.25,2)),3)+0.0 AS length FROM z WHERE round((h2-l2)*sqrt(1+pow(0.5/90.25,2)),3) > 0.001"
QUERIES["lines_outside_polygons"] = lambda spark, sf_dir: spatial.lines_outside_polygons(_zone_lines(spark, sf_dir), _zones(spark, sf_dir), 128.0, give="total").groupBy("line_id").agg(r(F.sum("length"), "length", 2))
QUERIES["intersecting_lines"] = lambda spark, sf_dir: (
    spatial.intersecting_lines(_zone_lines(spark, sf_dir), _suppliers(spark, sf_dir).select("id", F.array(point(c("x") + 0.375, c("y") - 20.125), point(c("x") + 0.375, c("y") + 60.625)).alias("geometry")), 128.0).select("a_id", "b_id", r(c("points")[0]["y"], "y", 3))
)
SQL["intersecting_lines"] = f"""WITH {_PTS} SELECT cu.id a_id, su.id b_id, round(cu.y+0.5*(su.x+0.375-cu.x)/90.25,3)+0.0 AS y FROM cu, su
 WHERE su.x+0.375 BETWEEN cu.x AND cu.x+90.25 AND cu.y+0.5*(su.x+0.375-cu.x)/90.25 BETWEEN su.y-20.125 AND su.y+60.625"""
QUERIES["nearest_line"] = lambda spark, sf_dir: (
    spatial.nearest_line(_customers(spark, sf_dir), _suppliers(spark, sf_dir).select("id", F.array(point(c("x"), c("y")), point(c("x") + 40, c("y") + 9)).alias("geometry")), 60.0).select("point_id", r(c("distance"), "distance", 3))
)
SQL["nearest_line"] = f"""WITH {_PTS}, d AS (SELECT cu.id, cu.x-su.x px, cu.y-su.y py FROM cu, su), t AS (SELECT *, greatest(0.0,least(1.0,(px*40+py*9)/1681.0)) t FROM d),
 n AS (SELECT id, min(sqrt(pow(px-t*40,2)+pow(py-t*9,2))) d FROM t GROUP BY id) SELECT id AS point_id, CASE WHEN d<=60 THEN round(d,3)+0.0 END AS distance FROM n"""
