"""Queries of overlays, buffers, lengths, lists and what else has none elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import lists, regions
from wayloom.functions import polygon as P
from wayloom.functions import scalar as S
from wayloom.functions import shapes
from wayloom.operators import network, reshape, spatial, turns
from wayloom.operators.staged import spread
from wayloom.plans.lines import SQL_V
from wayloom.plans.network import _E, _SQL_TURNS, _edges
from wayloom.plans.spatial import _HZ, _PTS, _rectangles, _zone_lines, _zones
from wayloom.plans.tables import SQL_LENGTH, r, table
from wayloom.sources import tables

QUERIES, SQL = {}, {}
c = F.col
GEOMETRY_LENGTH = SQL_LENGTH.replace("g[", "geometry[").replace("len(g)", "len(geometry)")


def _signed(rings):
    return F.aggregate(rings, F.lit(0.0), lambda s, ring: s + P.signed_area(ring))


# --- areas ------------------------------------------------------------------


def _overlaps(spark, sf_dir):
    sides = [df.select("id", "geometry") for df in (_rectangles(spark, sf_dir), _zones(spark, sf_dir))]
    hows = {"intersection": "shared", "union": "joined", "difference": "left_over", "symmetric_difference": "either"}
    out = spatial.overlay_areas(*sides, 128.0, list(hows)).select(c("a_id").alias("part"), c("b_id").alias("zone"), *[r(_signed(c(how)), name, 2) for how, name in hows.items()])
    return out.where("shared > 0")


QUERIES["overlay_shapes"] = _overlaps
SQL["overlay_shapes"] = f"""WITH {_PTS}, o AS (SELECT re.id part, su.id zone, w*h a, greatest(0.0,least(su.x+100.0,re.x+w)-greatest(su.x,re.x)) * greatest(0.0,least(su.y+100.0,re.y+h)-greatest(su.y,re.y)) s FROM su, re)
 SELECT part, zone, round(s,2)+0.0 AS shared, round(a+10000-s,2)+0.0 AS joined, round(a-s,2)+0.0 AS left_over, round(a+10000-2*s,2)+0.0 AS either FROM o WHERE s>0"""
_DISC = "16*sin(2*pi()/32)"  # the area of a disc of radius 1 drawn with 32 corners
for cap, sql in {"round": f"2*4.0*l + 16.0*{_DISC}", "flat": "2*4.0*l", "square": "2*4.0*l + 64.0"}.items():
    QUERIES[f"buffer_lines_{cap}"] = lambda spark, sf_dir, cap=cap: spread(_zone_lines(spark, sf_dir)).select("id", r(_signed(regions.buffer_line(c("geometry"), 4.0, cap=cap)), "area", 2))
    SQL[f"buffer_lines_{cap}"] = f"WITH {_PTS} SELECT id, round({sql},2)+0.0 AS area FROM (SELECT id, sqrt(90.25*90.25+0.25) l FROM cu)"
QUERIES["buffer_areas"] = lambda spark, sf_dir: spread(_rectangles(spark, sf_dir)).select("id", r(_signed(regions.buffer_area(c("geometry"), 3.0)), "grown", 2), r(_signed(regions.buffer_area(c("geometry"), -3.0)), "shrunk", 2))
SQL["buffer_areas"] = f"WITH {_PTS} SELECT id, round(w*h + 2*3*(w+h) + 9*{_DISC},2)+0.0 AS grown, round(greatest(w-6,0)*greatest(h-6,0),2)+0.0 AS shrunk FROM re"
QUERIES["lines_meeting_polygons"] = lambda spark, sf_dir: spatial.lines_meeting_polygons(_zone_lines(spark, sf_dir), _zones(spark, sf_dir), 128.0).select("id")
SQL["lines_meeting_polygons"] = f"WITH {_HZ} SELECT DISTINCT line_id AS id FROM z WHERE h2 >= l2"
QUERIES["areas_meeting_polygons"] = lambda spark, sf_dir: spatial.areas_meeting_polygons(_rectangles(spark, sf_dir), _zones(spark, sf_dir), 128.0).select("id")
SQL["areas_meeting_polygons"] = f"WITH {_PTS} SELECT DISTINCT re.id FROM re, su WHERE re.x<=su.x+100 AND re.x+w>=su.x AND re.y<=su.y+100 AND re.y+h>=su.y"
QUERIES["lines_outside_by_polygon"] = lambda spark, sf_dir: (
    spatial.lines_outside_polygons(_zone_lines(spark, sf_dir), _zones(spark, sf_dir), 128.0, give="total").select("line_id", "polygon_id", r(c("length"), "length", 2)).where("length > 0.01")
)
SQL["lines_outside_by_polygon"] = f"""WITH {_HZ}, i AS (SELECT line_id, polygon_id, greatest(h2-l2,0) n FROM z), m AS (SELECT line_id, polygon_id FROM o WHERE hi>=lo AND y+0.5>=sy AND y<=sy+100)
 SELECT line_id, polygon_id, round((90.25-coalesce(n,0))*sqrt(1+pow(0.5/90.25,2)),2)+0.0 AS length FROM m LEFT JOIN i USING (line_id, polygon_id) WHERE round((90.25-coalesce(n,0))*sqrt(1+pow(0.5/90.25,2)),2) > 0.01"""

# --- lines ------------------------------------------------------------------

QUERIES["line_split_points"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 1").select("ord", F.posexplode(L.split_at_points(c("geometry"), F.array(L.midpoint(c("geometry"))))).alias("k", "s")).select("ord", "k", r(L.length(c("s")), "length", 3))
)
SQL["line_split_points"] = f"WITH {SQL_V} SELECT ord, CAST(k AS INT) k, round(total/2,3)+0.0 AS length FROM t, range(0,2) q(k)"
QUERIES["line_split_crossings"] = lambda spark, sf_dir: (
    _zone_lines(spark, sf_dir).select("id", F.posexplode(L.split_at_crossings(c("geometry"), F.array(F.struct((c("geometry")[0]["x"] + 30.125).alias("x"), (c("geometry")[0]["y"] - 5).alias("y")), F.struct((c("geometry")[0]["x"] + 30.125).alias("x"), (c("geometry")[0]["y"] + 5).alias("y"))))).alias("k", "s"))
    .select("id", "k", r(L.length(c("s")), "length", 3))
)
SQL["line_split_crossings"] = f"WITH {_PTS} SELECT id, CAST(k AS INT) k, round(CASE k WHEN 0 THEN 30.125 ELSE 60.125 END*sqrt(1+pow(0.5/90.25,2)),3)+0.0 AS length FROM cu, range(0,2) q(k)"
QUERIES["linear_references"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 1").select("ord", F.inline(F.array(L.linear_reference(c("geometry"), F.array(L.first(c("geometry")), L.first(c("geometry"))))))).select("ord", r(c("lo"), "lo", 3), r(c("hi"), "hi", 3))
)
SQL["linear_references"] = "SELECT ord, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi FROM edges WHERE len(geometry) > 1"
QUERIES["merge_multiline_parts"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").where("size(geometry) > 2").select("ord", shapes.merge_multiline(F.array(F.slice("geometry", F.lit(2), F.size("geometry")), F.reverse(F.slice("geometry", 1, 2))), 0.0).alias("m")).select("ord", F.size("m").alias("lines"), r(L.length(c("m")[0]), "length", 3))
)
SQL["merge_multiline_parts"] = f"WITH {SQL_V} SELECT ord, 1 AS lines, round(total,3)+0.0 AS length FROM t JOIN (SELECT rid FROM e WHERE len(g)>2) USING (rid)"
QUERIES["maps_urls"] = lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", S.maps_url((c("c_custkey") % 90).cast("double") + 0.5, (c("c_custkey") % 180).cast("double") + 0.25).alias("url"))
SQL["maps_urls"] = "SELECT c_custkey, concat('https://maps.google.com/?ll=', c_custkey%90+0.5::DOUBLE, ',', c_custkey%180+0.25::DOUBLE) AS url FROM customer"

# --- networks ---------------------------------------------------------------

QUERIES["ensure_length"] = lambda spark, sf_dir: network.ensure_length(_edges(spark, sf_dir)).select("ord", r(c("length"), "length", 3))
SQL["ensure_length"] = f"WITH {_E} SELECT ord, round(coalesce(length, CASE WHEN len(geometry)>0 THEN {GEOMETRY_LENGTH} END, 0),3)+0.0 AS length FROM e"
QUERIES["turn_lengths"] = lambda spark, sf_dir: network.set_turn_lengths(turns.build_turns(_edges(spark, sf_dir)).withColumn("length", F.lit(1.0)), right=2.0, left=6.0, straight=3.0, u_turn=9.0).select("turn_u", "turn_v", "length")
SQL["turn_lengths"] = f"WITH {_SQL_TURNS} SELECT turn_u, turn_v, CASE dir WHEN 'right' THEN 2.0::DOUBLE WHEN 'left' THEN 6.0 WHEN 'straight' THEN 3.0 WHEN 'U' THEN 9.0 ELSE 1.0 END AS length FROM x"
QUERIES["turns_between_exits"] = lambda spark, sf_dir: turns.between_exits(turns.build_turns(_edges(spark, sf_dir)))
SQL["turns_between_exits"] = f"WITH {_SQL_TURNS}, o AS (SELECT DISTINCT u_out osmid, turn_v FROM x) SELECT a.turn_v AS turn_u, b.turn_v, a.osmid FROM o a JOIN o b ON a.osmid=b.osmid AND a.turn_v<>b.turn_v"
QUERIES["field_calculate"] = lambda spark, sf_dir: (
    network.field_calculate(_edges(spark, sf_dir).select("ord", "u", "v", "name"), "label", lambda row: None if row["name"] is None else f"{row['ord']}:{row['name'].upper()}:{len(row['u'] + row['v'])}", "string").select("ord", "label")
)
SQL["field_calculate"] = f"WITH {_E} SELECT ord, CASE WHEN name IS NOT NULL THEN concat(ord, ':', upper(name), ':', length(u)+length(v)) END AS label FROM e"
QUERIES["add_edges"] = lambda spark, sf_dir: network.add_edges(_edges(spark, sf_dir).select("ord", "u", "v", "key", "geometry", "length"), _edges(spark, sf_dir).where("size(geometry) > 1").select("ord", c("v").alias("u"), c("u").alias("v"), "key", F.reverse("geometry").alias("geometry"))).select("ord", "u", "v", r(c("length"), "length", 3))
SQL["add_edges"] = f"WITH {_E} SELECT ord, u, v, round(length,3)+0.0 AS length FROM e UNION ALL SELECT ord, v, u, round({GEOMETRY_LENGTH},3)+0.0 FROM e WHERE len(geometry)>1"
_CLOSE = f"""{_E}, p AS (SELECT ord,0 k,geometry[1].x x,geometry[1].y y FROM e WHERE len(geometry)>0 UNION ALL SELECT ord,1,geometry[-1].x,geometry[-1].y FROM e WHERE len(geometry)>0),
 f AS (SELECT x,y,min(ord*2+k) f FROM p GROUP BY x,y), l AS (SELECT a.f a, b.f b FROM f a JOIN f b ON b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<=1),
 w AS (SELECT f a, f b FROM f UNION SELECT w.a, l.b FROM w JOIN l ON l.a=w.b), m AS (SELECT a f, min(b) root FROM w GROUP BY a),
 n AS (SELECT root, row_number() OVER (ORDER BY root)-1 node FROM (SELECT DISTINCT root FROM m)), q AS (SELECT x,y,node FROM f JOIN m USING (f) JOIN n USING (root))"""
QUERIES["nodes_linked_within"] = lambda spark, sf_dir: network.nodes_from_edges(_edges(spark, sf_dir), "ord", 1.0)[0].select("ord", "u", "v")
SQL["nodes_linked_within"] = f"WITH RECURSIVE {_CLOSE} SELECT a.ord, na.node u, nb.node v FROM (SELECT * FROM p WHERE k=0) a JOIN (SELECT * FROM p WHERE k=1) b USING (ord) JOIN q na ON na.x=a.x AND na.y=a.y JOIN q nb ON nb.x=b.x AND nb.y=b.y"
_CHAINS = f"""{_E}, r AS (SELECT ord e, u, v, length FROM e WHERE u IS NOT NULL AND v IS NOT NULL), d AS (SELECT u n, v m, 1 o FROM r UNION ALL SELECT v, u, 0 FROM r),
 i AS (SELECT n FROM d GROUP BY n HAVING count(DISTINCT m)=2 AND count(*) IN (2,4) AND max(CASE WHEN n=m THEN 1 ELSE 0 END)=0 AND sum(o)>0 AND sum(o)<count(*)),
 b AS (SELECT x.e bf, x.u fr, x.v n FROM r x JOIN i ON x.v=i.n), k AS (SELECT r.e, min(bf) bf FROM r JOIN b ON r.u=b.n WHERE fr<>r.v GROUP BY r.e HAVING count(*)=1),
 w AS (SELECT e, e head, 0 place FROM r WHERE e NOT IN (SELECT e FROM k) UNION ALL SELECT k.e, w.head, w.place+1 FROM w JOIN k ON k.bf=w.e),
 a AS (SELECT * FROM w UNION ALL SELECT e, e, 0 FROM r WHERE e NOT IN (SELECT e FROM w)), z AS (SELECT head, place, u, v, length FROM a JOIN r USING (e))"""
QUERIES["chains"] = lambda spark, sf_dir: network.contract_chains(_edges(spark, sf_dir)).select("u", "v", "ord", "edges", r(c("length"), "length", 3))
SQL["chains"] = f"WITH RECURSIVE {_CHAINS} SELECT arg_min(u,place) u, arg_max(v,place) v, head AS ord, CAST(count(*) AS INT) AS edges, round(sum(length),3)+0.0 AS length FROM z GROUP BY head"

# --- tables and lists -------------------------------------------------------

QUERIES["map_columns"] = lambda spark, sf_dir: reshape.map_columns(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name"), lambda x: x + 1)
SQL["map_columns"] = "SELECT n_nationkey+1 AS n_nationkey, n_regionkey+1 AS n_regionkey, n_name FROM nation"
QUERIES["map_new_column"] = lambda spark, sf_dir: network.field_calculate(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "initials", lambda row: row["n_name"][:2].lower(), "string", ["n_name"])
SQL["map_new_column"] = "SELECT n_nationkey, n_name, lower(n_name[1:2]) AS initials FROM nation"
QUERIES["plain_names"] = lambda spark, sf_dir: reshape.flatten_struct_names(reshape.no_space_names(table(spark, sf_dir, "region").select(c("r_regionkey").alias("region key"), F.struct(c("r_name").alias("name"), c("r_regionkey").alias("key")).alias("r"))))
SQL["plain_names"] = "SELECT r_regionkey AS region_key, r_name, r_regionkey AS r_key FROM region"
QUERIES["multi_parts"] = lambda spark, sf_dir: reshape.multi_parts(table(spark, sf_dir, "edges").select("ord", "geometry").distinct()).select("ord", F.size("geometry").alias("parts"), F.size(c("geometry")[0]).alias("vertices"))
SQL["multi_parts"] = "SELECT ord, 1 AS parts, CAST(len(geometry) AS INT) AS vertices FROM (SELECT DISTINCT ord, geometry FROM edges)"
QUERIES["list_helpers"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "edges").select("ord", "highway").distinct().where("size(highway) > 0").select(
        "ord", lists.first(c("highway")).alias("first"), lists.last(c("highway")).alias("last"), lists.middle(c("highway")).alias("middle"), lists.unlistify(c("highway")).alias("only"),
        lists.concatenate(c("highway"), "+").alias("joined"), F.size(lists.drop_repeats(c("highway"))).alias("different"), F.size(lists.flatten(F.array("highway", "highway"))).alias("doubled"), F.size(lists.listify(c("highway"))).alias("wrapped"),
    )
)
SQL["list_helpers"] = """SELECT ord, highway[1] AS "first", highway[-1] AS "last", highway[len(highway)//2+1] AS middle, CASE WHEN len(highway)=1 THEN highway[1] END AS "only",
 array_to_string(highway,'+') AS joined, CAST(len(list_distinct(highway))+CASE WHEN len(list_filter(highway, lambda h: h IS NULL))>0 THEN 1 ELSE 0 END AS INT) AS different, CAST(2*len(highway) AS INT) AS doubled, 1 AS wrapped
 FROM (SELECT DISTINCT ord, highway FROM edges) WHERE len(highway)>0"""
QUERIES["edge_table_names"] = lambda spark, sf_dir: tables.edge_columns(table(spark, sf_dir, "edges").select("ord", c("u").alias("a"), c("v").alias("b")), "a", "b", keep=["ord"])
SQL["edge_table_names"] = "SELECT u, v, 0 AS \"key\", ord FROM edges"
QUERIES["empty_table"] = lambda spark, sf_dir: tables.empty_frame(spark, {"id": "bigint", "name": "string"}, 3)
SQL["empty_table"] = "SELECT NULL::BIGINT AS id, NULL::VARCHAR AS name FROM range(0,3)"
