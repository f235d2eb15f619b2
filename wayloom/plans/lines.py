"""Queries of line functions over edge geometries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.plans.tables import SQL_LENGTH, r, table

QUERIES, SQL = {}, {}
c = F.col


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "edges").where("size(geometry) > 1").select("ord", F.col("geometry").alias("g"))


# every vertex with its place, and every segment, in SQL
SQL_V = f"""e AS (SELECT ord, row_number() OVER () rid, geometry g FROM edges WHERE len(geometry) > 1),
 s AS (SELECT ord, rid, i, g[i].x ax, g[i].y ay, g[i+1].x bx, g[i+1].y byy, len(g) n FROM (SELECT ord, rid, g, unnest(range(1, len(g))) i FROM e)),
 d AS (SELECT *, sqrt(pow(bx-ax,2)+pow(byy-ay,2)) long FROM s),
 m AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) before FROM d),
 t AS (SELECT rid, ord, sum(long) total FROM d GROUP BY rid, ord)"""


def _place_sql(place):
    """(rid, ord, k, x, y) of the points at places: ``place`` is SQL giving rid, ord, k, want."""
    return f"""w AS ({place}),
 f AS (SELECT w.rid, w.ord, w.k, w.want, arg_max(struct_pack(ax:=m.ax,ay:=m.ay,bx:=m.bx,byy:=m.byy,long:=m.long,before:=m.before), m.i) z
   FROM w JOIN m ON m.rid = w.rid AND (m.before <= w.want OR m.i = 1) GROUP BY ALL),
 p AS (SELECT rid, ord, k, want, z.ax + q*(z.bx-z.ax) x, z.ay + q*(z.byy-z.ay) y FROM (SELECT *, CASE WHEN z.long > 0 THEN least(1.0,(want - z.before)/z.long) ELSE 0 END q FROM f))"""


QUERIES["line_length"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", r(L.length(c("g")), "length"))
SQL["line_length"] = f"SELECT ord, round({SQL_LENGTH},4)+0.0 AS length FROM (SELECT ord, geometry g FROM edges WHERE len(geometry)>1)"
QUERIES["line_midpoint"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", L.midpoint(c("g")).alias("q")).select("ord", r(c("q.x"), "x", 3), r(c("q.y"), "y", 3))
SQL["line_midpoint"] = f"WITH {SQL_V}, {_place_sql('SELECT rid, ord, 0 k, total/2 want FROM t')} SELECT ord, round(x,3)+0.0 AS x, round(y,3)+0.0 AS y FROM p"
QUERIES["line_interpolate"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", L.interpolate(c("g"), F.pmod(c("ord"), F.lit(200)).cast("double")).alias("q")).select("ord", r(c("q.x"), "x", 3), r(c("q.y"), "y", 3))
SQL["line_interpolate"] = f"WITH {SQL_V}, {_place_sql('SELECT rid, ord, 0 k, least(total,(ord%200)::DOUBLE) want FROM t')} SELECT ord, round(x,3)+0.0 AS x, round(y,3)+0.0 AS y FROM p"
QUERIES["line_azimuth_at"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", r(L.azimuth_at(c("g"), F.pmod(c("ord"), F.lit(200)).cast("double")), "azimuth"))
SQL["line_azimuth_at"] = f"""WITH {SQL_V}, w AS (SELECT rid, ord, least(total,(ord%200)::DOUBLE) want FROM t),
 f AS (SELECT w.ord, w.rid, arg_max(struct_pack(ax:=ax,ay:=ay,bx:=bx,byy:=byy), i) z FROM w JOIN m ON m.rid=w.rid AND (before < want OR i = 1) GROUP BY w.ord, w.rid)
 SELECT ord, round(degrees(atan2(z.byy-z.ay, z.bx-z.ax)),4)+0.0 AS azimuth FROM f"""
QUERIES["line_vertices"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", F.posexplode("g").alias("i", "p")).select("ord", "i", c("p.x").alias("x"), c("p.y").alias("y"))
SQL["line_vertices"] = "SELECT ord, CAST(i-1 AS INT) i, geometry[i].x x, geometry[i].y y FROM (SELECT ord, geometry, unnest(range(1, len(geometry)+1)) i FROM edges WHERE len(geometry)>1)"
QUERIES["line_segments"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", F.posexplode(L.segments(c("g"))).alias("i", "s")).select("ord", "i", r(L.length(c("s")), "length"))
SQL["line_segments"] = f"WITH {SQL_V} SELECT ord, CAST(i-1 AS INT) i, round(long,4)+0.0 AS length FROM d"
for how, start in ((False, "0.0"), ("point", "total/2 - floor(total/2/30)*30"), ("space", "(total-floor(total/30)*30)/2")):
    name = f"spaced_points_{how or 'none'}"
    QUERIES[name] = lambda spark, sf_dir, how=how: (
        _lines(spark, sf_dir).select("ord", F.posexplode(L.spaced_points(c("g"), 30.0, how)).alias("k", "q")).select("ord", "k", r(c("q.place"), "place"), r(c("q.x"), "x", 3), r(c("q.y"), "y", 3))
    )
    SQL[name] = f"""WITH {SQL_V}, {_place_sql(f'SELECT rid, ord, k, {start} + k*30.0 AS want FROM (SELECT *, unnest(range(0, CAST(ceil(total/30) AS BIGINT))) k FROM t)')}
 SELECT ord, CAST(k AS INT) k, round(want,4)+0.0 AS place, round(x,3)+0.0 AS x, round(y,3)+0.0 AS y FROM p"""
QUERIES["line_split_dists"] = lambda spark, sf_dir: (
    _lines(spark, sf_dir).select("ord", F.posexplode(L.split_at(c("g"), F.array(F.lit(90.0), F.lit(25.0)))).alias("k", "s")).select("ord", "k", r(L.length(c("s")), "length"))
)
SQL["line_split_dists"] = f"""WITH {SQL_V}, b AS (SELECT ord, [0.0::DOUBLE, least(total,25.0), least(total,90.0), total] b FROM t)
 SELECT ord, CAST(k-1 AS INT) k, round(b[k+1]-b[k],4)+0.0 AS length FROM (SELECT ord, b, unnest(range(1,4)) k FROM b)"""
QUERIES["split_lines_equal"] = lambda spark, sf_dir: (
    _lines(spark, sf_dir).select("ord", F.posexplode(L.split_evenly(c("g"), 40.0, "segment", 12.0)).alias("k", "s"))
    .select("ord", "k", r(L.length(c("s")), "length"), r(L.first(c("s"))["x"], "x", 3))
)
SQL["split_lines_equal"] = f"""WITH {SQL_V}, st AS (SELECT *, (total-floor(total/40)*40)/2 st FROM t),
 cuts AS (SELECT rid, ord, total, list_filter(list_transform(range(0, CAST(ceil(total/40) AS BIGINT)), lambda k: st+k*40.0), lambda d: d>0 AND d<total AND d>=12 AND total-d>=12) cuts FROM st),
 b AS (SELECT rid, ord, list_concat([0.0::DOUBLE], cuts, [total]) b FROM cuts),
 {_place_sql('SELECT rid, ord, k, b[k] want FROM (SELECT *, unnest(range(1, len(b))) k FROM b)')}
 SELECT p.ord, CAST(k-1 AS INT) k, round(b.b[k+1]-b.b[k],4)+0.0 AS length, round(x,3)+0.0 AS x FROM p JOIN b USING (rid)"""
QUERIES["line_project"] = lambda spark, sf_dir: (
    _lines(spark, sf_dir).select("ord", L.nearest(F.struct((L.first(c("g"))["x"] + 31).alias("x"), (L.first(c("g"))["y"] - 17).alias("y")), c("g")).alias("n")).select("ord", r(c("n.distance"), "distance", 3))
)
SQL["line_project"] = f"""WITH {SQL_V}, q AS (SELECT rid, ord, g[1].x+31 px, g[1].y-17 py FROM e),
 a AS (SELECT q.rid, q.ord, px, py, ax, ay, bx-ax dx, byy-ay dy, CASE WHEN long>0 THEN greatest(0.0,least(1.0,((px-ax)*(bx-ax)+(py-ay)*(byy-ay))/(long*long))) ELSE 0 END t FROM q JOIN d USING (rid))
 SELECT ord, round(min(sqrt(pow(px-ax-t*dx,2)+pow(py-ay-t*dy,2))),3)+0.0 AS distance FROM a GROUP BY rid, ord"""
QUERIES["line_extend"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", L.extend(c("g"), 10.0).alias("h")).select("ord", r(L.first(c("h"))["x"], "x0", 3), r(L.last(c("h"))["y"], "y1", 3))
SQL["line_extend"] = """SELECT ord, round(geometry[1].x+cos(atan2(geometry[1].y-geometry[2].y,geometry[1].x-geometry[2].x))*10,3)+0.0 AS x0,
 round(geometry[-1].y+sin(atan2(geometry[-1].y-geometry[-2].y,geometry[-1].x-geometry[-2].x))*10,3)+0.0 AS y1 FROM edges WHERE len(geometry)>1"""
QUERIES["line_shorten"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("ord", r(L.length(L.shorten(c("g"), 20.0)), "length", 3))
SQL["line_shorten"] = f"WITH {SQL_V} SELECT ord, round(CASE WHEN total>=40 THEN total-40 WHEN total>=20 THEN 40-total ELSE total END,3)+0.0 AS length FROM t"
QUERIES["hausdorff_edges"] = lambda spark, sf_dir: (
    _lines(spark, sf_dir).select("ord", r(L.directed_hausdorff(c("g"), F.array(L.first(c("g")), L.last(c("g")))), "stray", 3))
)
SQL["hausdorff_edges"] = """WITH v AS (SELECT ord, rid, g[i].x px, g[i].y py, g[1].x ax, g[1].y ay, g[-1].x-g[1].x dx, g[-1].y-g[1].y dy FROM
  (SELECT ord, rid, g, unnest(range(1,len(g)+1)) i FROM (SELECT ord, row_number() OVER () rid, geometry g FROM edges WHERE len(geometry)>1))),
 t AS (SELECT *, CASE WHEN dx*dx+dy*dy>0 THEN greatest(0.0,least(1.0,((px-ax)*dx+(py-ay)*dy)/(dx*dx+dy*dy))) ELSE 0 END t FROM v)
 SELECT ord, round(max(sqrt(pow(px-ax-t*dx,2)+pow(py-ay-t*dy,2))),3)+0.0 AS stray FROM t GROUP BY rid, ord"""
QUERIES["merge_ordered_lines"] = lambda spark, sf_dir: (
    _lines(spark, sf_dir).select("ord", L.merge_ordered(F.array(c("g"), F.slice(c("g"), F.size("g"), 1), F.reverse("g"))).alias("h")).select("ord", F.size("h").alias("vertices"))
)
SQL["merge_ordered_lines"] = """WITH f AS (SELECT ord, list_concat(geometry, [geometry[-1]], list_reverse(geometry)) h FROM edges WHERE len(geometry)>1)
 SELECT ord, CAST(1+len(list_filter(range(2,len(h)+1), lambda i: h[i].x<>h[i-1].x OR h[i].y<>h[i-1].y)) AS INT) vertices FROM f"""
