"""Queries of scalar functions over edge ends and node positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import scalar as S
from wayloom.functions.let import point
from wayloom.plans.tables import r, table

QUERIES, SQL = {}, {}


def _ends(spark, sf_dir):
    e = table(spark, sf_dir, "edges").where("size(geometry) > 1")
    a, z = F.element_at("geometry", 1), F.element_at("geometry", -1)
    return e.select("ord", "length", a["x"].alias("x0"), a["y"].alias("y0"), z["x"].alias("x1"), z["y"].alias("y1")).withColumn(
        "a", S.azimuth(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    ).withColumn("b", F.pmod(F.col("ord") * 37, F.lit(900)) - 400.5)


SQL_ENDS = """ends AS (SELECT ord, length, geometry[1].x x0, geometry[1].y y0, geometry[-1].x x1, geometry[-1].y y1,
  degrees(atan2(geometry[-1].y-geometry[1].y, geometry[-1].x-geometry[1].x)) a, ((ord*37) % 900) - 400.5::DOUBLE b
  FROM edges WHERE len(geometry) > 1)"""
_N = "CASE WHEN {0} > 360 OR {0} < 0 THEN (({0} % 360) + 360) % 360 ELSE {0} END"


def _norm(v):
    return "(" + _N.format(f"({v})") + ")"


def _zero(v):
    return f"(CASE WHEN {_norm(v)} > 180 THEN {_norm(v)} - 360 ELSE {_norm(v)} END)"


def add(name, columns, sql, source=_ends, source_sql=SQL_ENDS, table_sql="ends"):
    """Registers a query of columns over a source, and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: source(spark, sf_dir).select(*columns())
    SQL[name] = f"WITH {source_sql} SELECT {sql} FROM {table_sql}"


c = F.col
add("azimuth_basic", lambda: [c("ord"), r(c("a"), "azimuth")], "ord, round(a,4)+0.0 AS azimuth")
add("azimuth_normalize", lambda: [c("ord"), r(S.normalize_azimuth(c("b")), "normalized"), r(S.normalize_azimuth(c("b"), True), "centered")],
    f"ord, round({_norm('b')},4)+0.0 AS normalized, round({_zero('b')},4)+0.0 AS centered")
for kind, how in (("directed", True), ("inverse", False), ("polar", "polar"), ("signed", "signed")):
    gap = "(abs(a-b) % 360)"
    full = f"least({gap}, 360-{gap})"
    sql = {"directed": full, "inverse": f"least({full}, 180-{full})", "polar": _norm("b-a"), "signed": _zero("b-a")}[kind]
    add(f"azimuth_diff_{kind}", lambda how=how: [c("ord"), r(S.azimuth_difference(c("a"), c("b"), how), "difference")], f"ord, round({sql},4)+0.0 AS difference")
add("degrees_center_zero", lambda: [c("ord"), r(S.degrees_centered_at_zero(c("b")), "centered")],
    "ord, round(CASE WHEN b > 180 THEN b-360 WHEN b <= -180 THEN b+360 ELSE b END,4)+0.0 AS centered")
add("side_label", lambda: [c("ord"), S.side_by_relative_angle(S.degrees_centered_at_zero(c("b") - c("a"))).alias("side")],
    "ord, CASE WHEN d < 0 THEN 'R' WHEN d > 0 THEN 'L' WHEN d = 0 THEN 'C' END AS side",
    source_sql=SQL_ENDS + ", s AS (SELECT ord, CASE WHEN b-a > 180 THEN b-a-360 WHEN b-a <= -180 THEN b-a+360 ELSE b-a END d FROM ends)", table_sql="s")
add("float_overlap", lambda: [c("ord"), r(S.float_overlap(F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")), "overlap")],
    "ord, round(greatest(0.0, least(greatest(x0,x1),greatest(y0,y1)) - greatest(least(x0,x1),least(y0,y1))),4)+0.0 AS overlap")
add("haversine_pairs", lambda: [c("ord"), r(S.haversine(c("x0") / 1000, c("y0") / 1000, c("x1") / 1000, c("y1") / 1000), "km"), r(S.haversine(c("x0") / 1000, c("y0") / 1000, c("x1") / 1000, c("y1") / 1000, "mi"), "mi")],
    "ord, round(2*asin(sqrt(h))*6371,4)+0.0 AS km, round(2*asin(sqrt(h))*3956,4)+0.0 AS mi",
    source_sql=SQL_ENDS + ", h AS (SELECT ord, pow(sin(radians((y1-y0)/1000)/2),2)+cos(radians(y0/1000))*cos(radians(y1/1000))*pow(sin(radians((x1-x0)/1000)/2),2) h FROM ends)", table_sql="h")
add("line_by_azimuth", lambda: [c("ord"), *[r(S.line_by_azimuth(point(c("x0"), c("y0")), c("length"), c("b"))[1][k], k, 3) for k in ("x", "y")]],
    "ord, round(x0+cos(radians(b))*length,3)+0.0 AS x, round(y0+sin(radians(b))*length,3)+0.0 AS y")
add("closest_point_segment", lambda: [c("ord"), *[r(S.closest_point_on_segment(c("x0") + c("b"), c("y0") - c("b") / 3, c("x0"), c("y0"), c("x1"), c("y1"))[k], k, 3) for k in ("x", "y")]],
    "ord, round(x0+t*(x1-x0),3)+0.0 AS x, round(y0+t*(y1-y0),3)+0.0 AS y",
    source_sql=SQL_ENDS + ", p AS (SELECT *, CASE WHEN n > 0 THEN greatest(0.0,least(1.0,(b*(x1-x0)-b/3*(y1-y0))/n)) ELSE 0 END t FROM (SELECT *, pow(x1-x0,2)+pow(y1-y0,2) n FROM ends))", table_sql="p")


def _crossed():
    mid = point((c("x0") + c("x1")) / 2 + 1, (c("y0") + c("y1")) / 2)
    cross = S.segment_intersection(point(c("x0"), c("y0")), point(c("x1"), c("y1")), mid, S.line_by_azimuth(mid, 40.0, c("b"))[1])
    return [c("ord"), r(cross["x"], "x", 3), r(cross["y"], "y", 3)]


QUERIES["segment_intersections"] = lambda spark, sf_dir: _ends(spark, sf_dir).select(*_crossed()).where("x is not null")
SQL["segment_intersections"] = f"""WITH {SQL_ENDS},
 l AS (SELECT ord,x0,y0,x1,y1,(x0+x1)/2+1 mx,(y0+y1)/2 my,cos(radians(b))*40 bx,sin(radians(b))*40 byy FROM ends),
 t AS (SELECT *, ((y1-y0)*(x0-mx)-(x1-x0)*(y0-my))/nullif((y1-y0)*bx-(x1-x0)*byy,0) t FROM l),
 p AS (SELECT *, mx+t*bx px, my+t*byy py FROM t)
 SELECT ord, round(px,3)+0.0 AS x, round(py,3)+0.0 AS y FROM p WHERE t IS NOT NULL
 AND px BETWEEN least(x0,x1) AND greatest(x0,x1) AND py BETWEEN least(y0,y1) AND greatest(y0,y1)
 AND px BETWEEN least(mx,mx+bx) AND greatest(mx,mx+bx) AND py BETWEEN least(my,my+byy) AND greatest(my,my+byy)"""
add("turn_direction", lambda: [c("ord"), S.turn_direction(S.normalize_azimuth(c("b"))).alias("direction")],
    "ord, CASE WHEN n < 20 OR n > 340 THEN 'straight' WHEN n <= 160 THEN 'left' WHEN n < 200 THEN 'U' WHEN n <= 340 THEN 'right' END AS direction",
    source_sql=SQL_ENDS + f", n AS (SELECT ord, {_norm('b')} n FROM ends)", table_sql="n")
QUERIES["color_parts"] = lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.hex(F.pmod(F.col("p_partkey") * 7919, F.lit(16777216))), 6, "0").alias("h")).select(
    "p_partkey", *[S.hex_to_rgb(c("h"))[k].alias(n) for k, n in enumerate("rgb")], r(S.rgb_to_dec(S.hex_to_rgb(c("h")))[0], "red", 6))
SQL["color_parts"] = "SELECT p_partkey, CAST(n//65536 AS INT) r, CAST(n//256%256 AS INT) g, CAST(n%256 AS INT) b, round((n//65536)/256.0::DOUBLE,6) red FROM (SELECT p_partkey, (p_partkey*7919)%16777216 n FROM part)"
