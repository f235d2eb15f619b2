"""Queries of network, turn, cost and routing operators over the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.operators import cost, network, routing, turns
from wayloom.plans.tables import SQL_LENGTH, r, table

QUERIES, SQL = {}, {}
c = F.col

FIELDS = ["ord", "u", "v", "key", "geometry", "length", "oneway", "highway", "edge_level", "name"]
_E = "e AS (SELECT DISTINCT ord, u, v, key, geometry, length, oneway, highway, edge_level, name FROM edges)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "edges").select(*FIELDS).distinct()


_SQL_TURNS = f"""{_E}, a AS (SELECT *, CASE WHEN len(geometry)>1 THEN degrees(atan2(geometry[2].y-geometry[1].y, geometry[2].x-geometry[1].x)) END fa,
  CASE WHEN len(geometry)>1 THEN (SELECT degrees(atan2(geometry[k+1].y-geometry[k].y, geometry[k+1].x-geometry[k].x)) FROM (SELECT coalesce(max(i),1) k FROM (SELECT unnest(range(1,len(geometry))) i) WHERE geometry[i].x<>geometry[i+1].x OR geometry[i].y<>geometry[i+1].y)) END ta,
  concat(u,'_out',row_number() OVER (PARTITION BY u ORDER BY ord,v,key)-1) tv, concat(v,'_in',row_number() OVER (PARTITION BY v ORDER BY ord,u,key)-1) tu FROM e),
 t AS (SELECT i.tu turn_u, o.tv turn_v, i.u u_in, i.v v_in, i.key key_in, o.u u_out, o.v v_out, o.key key_out, i.ta ia, o.fa oa, o.fa-i.ta d FROM a i JOIN a o ON i.v=o.u),
 n AS (SELECT *, CASE WHEN d>360 OR d<0 THEN ((d%360)+360)%360 ELSE d END rel FROM t),
 k AS (SELECT *, CASE WHEN rel<20 OR rel>340 THEN 'straight' WHEN rel<=160 THEN 'left' WHEN rel<200 THEN 'U' WHEN rel<=340 THEN 'right' END dir FROM n),
 w AS (SELECT *, row_number() OVER (PARTITION BY turn_u, coalesce(dir='U',true) ORDER BY rel,turn_v) rk, count(*) OVER (PARTITION BY turn_u, coalesce(dir='U',true)) cn,
   coalesce(max(CASE WHEN dir='right' THEN 1 ELSE 0 END) OVER (PARTITION BY turn_u),0) ar FROM k),
 p AS (SELECT *, CASE WHEN dir='U' THEN 'near' WHEN dir IS NOT NULL THEN CASE WHEN rk=1 OR rk=cn THEN 'near' ELSE 'far' END END prox FROM w),
 x AS (SELECT *, NOT (dir='right' AND prox='near') AND NOT (dir='straight' AND ar=0) across FROM p)"""
QUERIES["turns_build"] = lambda spark, sf_dir: turns.build_turns(_edges(spark, sf_dir)).select("turn_u", "turn_v", "u_in", "v_in", "key_in", "u_out", "v_out", "key_out", r(c("relative_azimuths"), "relative_azimuths", 3), "turn_direction", "turn_proximity", "turn_across")
SQL["turns_build"] = f"WITH {_SQL_TURNS} SELECT turn_u, turn_v, u_in, v_in, key_in, u_out, v_out, key_out, round(rel,3)+0.0 AS relative_azimuths, dir AS turn_direction, prox AS turn_proximity, across AS turn_across FROM x"
QUERIES["turns_levels"] = lambda spark, sf_dir: (
    turns.attach_edge_attributes(turns.build_turns(_edges(spark, sf_dir)), _edges(spark, sf_dir), level="edge_level").select("turn_u", "turn_v", "in_level", "out_level", "delta_level", "max_level", "cross_level")
)
SQL["turns_levels"] = f"""WITH {_SQL_TURNS}, l AS (SELECT x.*, i.edge_level il, o.edge_level ol FROM x JOIN e i ON i.u=u_in AND i.v=v_in AND i.key=key_in JOIN e o ON o.u=u_out AND o.v=v_out AND o.key=key_out)
 SELECT turn_u, turn_v, il AS in_level, ol AS out_level, ol-il AS delta_level, max(greatest(il,ol)) OVER (PARTITION BY v_in) AS max_level,
 coalesce(max(CASE WHEN dir IN ('left','right') THEN ol END) OVER (PARTITION BY turn_u), max(greatest(il,ol)) OVER (PARTITION BY v_in)) AS cross_level FROM l"""
QUERIES["turns_combine"] = lambda spark, sf_dir: turns.combine_edges_and_turns(_edges(spark, sf_dir), turns.build_turns(_edges(spark, sf_dir))).select("u", "v", "key", "turn_u", "turn_v", "osmid")
SQL["turns_combine"] = f"""WITH {_SQL_TURNS}, bu AS (SELECT u_out u, v_out v, key_out key, min(turn_v) turn_u FROM x GROUP BY ALL), bv AS (SELECT u_in u, v_in v, key_in key, min(turn_u) turn_v FROM x GROUP BY ALL)
 SELECT e.u, e.v, e.key, coalesce(bu.turn_u,e.u) turn_u, coalesce(bv.turn_v,e.v) turn_v, NULL AS osmid FROM e LEFT JOIN bu USING (u,v,key) LEFT JOIN bv USING (u,v,key)
 UNION ALL SELECT NULL, NULL, NULL, turn_u, turn_v, v_in FROM x"""
QUERIES["backward_edges"] = lambda spark, sf_dir: network.backward_edges(_edges(spark, sf_dir), "ord").select("u", "v", "key", "ord", F.get("geometry", F.lit(0))["x"].alias("x0"))
SQL["backward_edges"] = f"""WITH {_E}, b AS (SELECT u,v,key,ord,geometry[1].x x0, 0 cp FROM e UNION ALL SELECT v,u,key,ord,geometry[-1].x, 1 FROM e WHERE NOT coalesce(oneway,false))
 SELECT u,v,key,ord,x0 FROM (SELECT *, row_number() OVER (PARTITION BY u,v,key ORDER BY cp,ord) n FROM b) WHERE n=1"""
QUERIES["subgraph_by_attr"] = lambda spark, sf_dir: network.subgraph_by_attribute(_edges(spark, sf_dir), "highway", ["residential", "service"]).select("ord", "u", "v", "key")
SQL["subgraph_by_attr"] = f"WITH {_E} SELECT ord,u,v,key FROM e WHERE list_has_any(highway,['residential','service'])"
QUERIES["fill_geometries"] = lambda spark, sf_dir: network.fill_geometries(_edges(spark, sf_dir), table(spark, sf_dir, "nodes")).select("ord", r(L.length(c("geometry")), "length"))
SQL["fill_geometries"] = f"""WITH {_E}, n AS (SELECT DISTINCT node,x,y FROM nodes) SELECT ord, round(CASE WHEN g IS NULL THEN sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) ELSE {SQL_LENGTH} END,4)+0.0 AS length
 FROM (SELECT ord,u,v,geometry g FROM e) LEFT JOIN n a ON a.node=u LEFT JOIN n b ON b.node=v"""
QUERIES["correct_direction"] = lambda spark, sf_dir: (
    network.correct_direction(_edges(spark, sf_dir).withColumn("geometry", F.when(c("ord") % 3 == 0, F.reverse("geometry")).otherwise(c("geometry"))), table(spark, sf_dir, "nodes")).where("geometry is not null").select("ord", F.get("geometry", F.lit(0))["x"].alias("x0"))
)
SQL["correct_direction"] = f"""WITH {_E}, n AS (SELECT DISTINCT node,x,y FROM nodes), g AS (SELECT ord,u,CASE WHEN ord%3=0 THEN list_reverse(geometry) ELSE geometry END g FROM e WHERE geometry IS NOT NULL)
 SELECT ord, CASE WHEN NOT (abs(g[1].x-x)<0.5e-6 AND abs(g[1].y-y)<0.5e-6) THEN g[-1].x ELSE g[1].x END x0 FROM g JOIN n ON node=u"""
QUERIES["lowest_cost_edge"] = lambda spark, sf_dir: network.lowest_cost_edge(_edges(spark, sf_dir).where("length is not null"), "length")
SQL["lowest_cost_edge"] = f"WITH {_E} SELECT u,v,key,length FROM (SELECT *, row_number() OVER (PARTITION BY u,v ORDER BY length,key) n FROM e WHERE length IS NOT NULL) WHERE n=1"
QUERIES["self_loop_split"] = lambda spark, sf_dir: network.split_self_loops(_edges(spark, sf_dir))[0].select("u", "v", "key", "ord", r(c("length"), "length", 3))
SQL["self_loop_split"] = f"""WITH {_E}, f AS (SELECT * FROM e), l AS (SELECT ord,u,v,key,oneway,geometry g, {SQL_LENGTH.replace('g[','geometry[').replace('len(g)','len(geometry)')} t FROM f WHERE u=v AND len(geometry)>1),
 s AS (SELECT *, concat(u,'_',key,'_a') a, concat(u,'_',key,'_b') b FROM l)
 SELECT u,v,key,ord,round(length,3)+0.0 AS length FROM f WHERE NOT (u=v AND coalesce(len(geometry),0)>1)
 UNION ALL SELECT p[1],p[2],0,ord,round(t/3,3)+0.0 FROM (SELECT ord,t,oneway,unnest([[u,a,'f'],[a,b,'f'],[b,v,'f'],[a,u,'b'],[b,a,'b'],[v,b,'b']]) p FROM s) WHERE p[3]='f' OR NOT coalesce(oneway,false)"""
QUERIES["insert_nodes"] = lambda spark, sf_dir: (
    network.insert_nodes(_edges(spark, sf_dir).where("size(geometry) > 1"), _edges(spark, sf_dir).select("ord", F.lit(20.0).alias("place"), F.concat(F.lit("n"), "ord").alias("node"))).select("u", "v", "key", "ord", "piece", r(F.when(c("piece").isNotNull(), c("length")), "length", 3))
)
SQL["insert_nodes"] = f"""WITH {_E}, l AS (SELECT ord,u,v,key,{SQL_LENGTH.replace('g[','geometry[').replace('len(g)','len(geometry)')} t FROM e WHERE len(geometry)>1)
 SELECT u,concat('n',ord) v,key,ord,0 piece,round(least(t,20.0),3)+0.0 AS length FROM l UNION ALL SELECT concat('n',ord),v,key,ord,1,round(t-least(t,20.0),3)+0.0 FROM l"""
QUERIES["edge_levels"] = lambda spark, sf_dir: _edges(spark, sf_dir).select("ord", cost.edge_level(c("highway")).alias("level"))
SQL["edge_levels"] = "SELECT ord, " + "coalesce(greatest(" + ",".join(f"CASE WHEN len(list_filter(highway, lambda h: regexp_matches(h,'{p}')))>0 THEN {v} END" for p, v in cost.LEVELS.items()) + "),0) AS level FROM " + "(SELECT DISTINCT ord,highway FROM edges)"
QUERIES["edge_time_weighted"] = lambda spark, sf_dir: (
    _edges(spark, sf_dir).select("ord", r(cost.edge_seconds(c("geometry"), 4.5, c("highway"), [("primary.*", 0.8), ("track|path", 2.0), ("footway", 0)], F.array("edge_level"), [(range(0, 2), 3), (4, 7)]), "seconds", 3))
)
SQL["edge_time_weighted"] = f"""WITH {_E}, g AS (SELECT ord, highway h, edge_level l, CASE WHEN geometry IS NULL THEN 0 ELSE {SQL_LENGTH.replace('g[','geometry[').replace('len(g)','len(geometry)')} END t FROM e)
 SELECT ord, round(t/4.5 * CASE WHEN len(list_filter(h, lambda x: regexp_matches(x,'primary.*')))>0 THEN 0.8 WHEN len(list_filter(h, lambda x: regexp_matches(x,'track|path')))>0 THEN 2.0 ELSE 1.0 END
  + CASE WHEN l>=0 AND l<2 THEN 3 WHEN l=4 THEN 7 ELSE 0 END,3)+0.0 AS seconds FROM g"""


def _routes(spark, sf_dir):
    """Each edge and the next one on from its end, to the least node."""
    e = _edges(spark, sf_dir)
    on = e.groupBy("u").agg(F.min("v").alias("w")).select(c("u").alias("v"), "w")
    return e.join(on, "v").select(c("ord").alias("route_id"), F.array("u", "v", "w").alias("route"))


_SQL_ROUTES = f"{_E}, rt AS (SELECT ord route_id, e.u a, e.v b, w FROM e JOIN (SELECT u b, min(v) w FROM e GROUP BY u) o ON o.b=e.v), st AS (SELECT route_id, 0 seq, a u, b v FROM rt UNION ALL SELECT route_id, 1, b, w FROM rt)"
QUERIES["route_edge_counts"] = lambda spark, sf_dir: routing.count_along_edges(_routes(spark, sf_dir), _edges(spark, sf_dir).select("u", "v", "key", "ord"))
SQL["route_edge_counts"] = f"WITH {_SQL_ROUTES}, n AS (SELECT u,v,count(*) route_count FROM st GROUP BY ALL) SELECT u,v,key,ord,route_count FROM e JOIN n USING (u,v)"
QUERIES["route_summary"] = lambda spark, sf_dir: (
    routing.summarize_routes(_routes(spark, sf_dir), _edges(spark, sf_dir).select("u", "v", "key", "length", "geometry", "edge_level"), {"top_level": F.max("edge_level")}).select("route_id", r(c("route_length"), "route_length", 3), "steps", "top_level")
)
SQL["route_summary"] = f"""WITH {_SQL_ROUTES}, b AS (SELECT u,v,length,edge_level FROM (SELECT *, row_number() OVER (PARTITION BY u,v ORDER BY length NULLS FIRST,key) n FROM e) WHERE n=1)
 SELECT route_id, round(coalesce(sum(length),'Infinity'::DOUBLE),3)+0.0 AS route_length, count(*) steps, max(edge_level) top_level FROM st LEFT JOIN b USING (u,v) GROUP BY route_id"""


def _nation_net(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("a"))
    m = n.select(c("a").alias("b"))
    return n.join(m, (c("b") - c("a")).isin(1, 5, 7)).select(c("a").cast("string").alias("u"), c("b").cast("string").alias("v"), F.lit(0).alias("key"), ((7 * c("a") + 13 * c("b")) % 17 + 1).cast("double").alias("length"))


def _nation_pairs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.lit("0").alias("origin"), c("n_nationkey").cast("string").alias("destination"))


_SQL_SSSP = """WITH RECURSIVE n AS (SELECT a.n_nationkey u, b.n_nationkey v, (7*a.n_nationkey+13*b.n_nationkey)%17+1 w FROM nation a JOIN nation b ON b.n_nationkey-a.n_nationkey IN (1,5,7)),
 p AS (SELECT 0 node, 0 cost UNION ALL SELECT v, cost+w FROM p JOIN n ON node=u)
 SELECT '0' AS origin, CAST(node AS VARCHAR) destination, CAST(min(cost) AS DOUBLE) AS cost FROM p GROUP BY node"""
QUERIES["sssp_small"] = lambda spark, sf_dir: routing.shortest_paths(_nation_pairs(spark, sf_dir), _nation_net(spark, sf_dir)).select("origin", "destination", "cost")
QUERIES["sssp_tables"] = lambda spark, sf_dir: routing.shortest_paths(_nation_pairs(spark, sf_dir), _nation_net(spark, sf_dir), max_broadcast=0).select("origin", "destination", "cost")
SQL["sssp_small"] = SQL["sssp_tables"] = _SQL_SSSP


def _two_way_net(spark, sf_dir):
    """Edges both ways between nations, many of them without cost, so that ways without cost go round in circles."""
    forth = _nation_net(spark, sf_dir).withColumn("length", F.pmod(c("length"), F.lit(3.0)))
    return forth.unionByName(forth.select(c("v").alias("u"), c("u").alias("v"), "key", "length"))


for how, most in (("", routing.MAX_BROADCAST_BYTES), ("_tables", 0)):
    QUERIES[f"sssp_zero{how}"] = lambda spark, sf_dir, most=most: routing.shortest_paths(_nation_pairs(spark, sf_dir), _two_way_net(spark, sf_dir), max_broadcast=most).select("origin", "destination", "cost", (F.size("route") - 1).alias("steps"))
    SQL[f"sssp_zero{how}"] = """WITH RECURSIVE m AS (SELECT a.n_nationkey u, b.n_nationkey v, ((7*a.n_nationkey+13*b.n_nationkey)%17+1)%3 w FROM nation a JOIN nation b ON b.n_nationkey-a.n_nationkey IN (1,5,7)),
 n AS (SELECT * FROM m UNION ALL SELECT v, u, w FROM m), p AS (SELECT 0 node, 0 cost, 0 h UNION SELECT v, cost+w, h+1 FROM p JOIN n ON node=u WHERE h<24 AND cost<20)
 SELECT '0' AS origin, CAST(node AS VARCHAR) destination, CAST(min(cost) AS DOUBLE) AS cost, CAST(arg_min(h, cost*100+h) AS INT) AS steps FROM p GROUP BY node"""


def _route_all(spark, sf_dir):
    """The way from the south-western node to every other node: one search over the whole network."""
    at = table(spark, sf_dir, "nodes").select("node", "x", "y").distinct()
    corner = F.broadcast(at.agg(F.min(F.struct("x", "y", "node")).alias("a")))
    pairs = at.join(corner).select(c("a.node").alias("origin"), c("node").alias("destination"))
    return routing.shortest_paths(pairs, _edges(spark, sf_dir), routes=False).select("destination", r(c("cost"), "cost", 3), "steps")


QUERIES["route_pairs"] = _route_all
QUERIES["chain_contract"] = lambda spark, sf_dir: network.contract_chains(_edges(spark, sf_dir)).select("u", "v", "ord", "edges", r(c("length"), "length", 3))
QUERIES["nodes_from_edges"] = lambda spark, sf_dir: network.nodes_from_edges(_edges(spark, sf_dir), "ord", 0.0)[0].select("ord", "u", "v")
SQL["nodes_from_edges"] = f"""WITH {_E}, p AS (SELECT ord,0 k,geometry[1].x x,geometry[1].y y FROM e WHERE len(geometry)>0 UNION ALL SELECT ord,1,geometry[-1].x,geometry[-1].y FROM e WHERE len(geometry)>0),
 f AS (SELECT x,y,min(ord*2+k) f FROM p GROUP BY x,y), n AS (SELECT x,y,row_number() OVER (ORDER BY f)-1 node FROM f)
 SELECT a.ord, na.node u, nb.node v FROM (SELECT * FROM p WHERE k=0) a JOIN (SELECT * FROM p WHERE k=1) b USING (ord) JOIN n na ON na.x=a.x AND na.y=a.y JOIN n nb ON nb.x=b.x AND nb.y=b.y"""
QUERIES["nodes_within_distance"] = lambda spark, sf_dir: network.nodes_from_edges(_edges(spark, sf_dir), "ord", 1.0)[0].select("ord", "u", "v")
