import heapq
import json
import random

from pyspark.sql import functions as F

from wayloom.operators import buildings, conflate, connect, intervals, network, reshape, routing, spatial, turns
from wayloom.sources import census, overpass, tables
from wayloom.streaming import positions

LINE = "array<struct<x:double,y:double>>"
EDGE = f"ord bigint, u string, v string, key int, geometry {LINE}, length double, oneway boolean, edge_level int"


def straight(n, u, v, at, key=0, oneway=True, level=1):
    g = [at[u], at[v]]
    return n, u, v, key, g, ((g[0][0] - g[1][0]) ** 2 + (g[0][1] - g[1][1]) ** 2) ** 0.5, oneway, level


def test_reshape(spark):
    df = spark.createDataFrame([(1, "x", [1, None, 2], ("p", 3)), (2, None, None, ("q", 4))], "id int, c string, l array<int>, s struct<a:string,b:int>")
    assert reshape.move_column(df, "c", -1).columns == ["id", "l", "s", "c"] and reshape.first_column(df, "s").columns[0] == "s"
    assert reshape.flatten_struct_names(df).columns == ["id", "c", "l", "s_a", "s_b"]
    assert [tuple(r) for r in reshape.explode_list(df, "l", ["id"], "i").collect()] == [(1, 0, 1), (1, 2, 2)]
    assert [tuple(r) for r in reshape.one_hot(df.select("id", "c"), "c", "is_").collect()] == [(1, 1), (2, 0)]
    assert [tuple(r) for r in reshape.spread_list(df.select("id", "l"), "l", ["a", "b"]).collect()] == [(1, 1, None), (2, None, None)]
    assert reshape.map_columns(df.select("id", "c"), lambda c: c + 1).collect()[0].id == 2
    assert reshape.no_space_names(df.toDF("a b", "c", "l", "s")).columns[0] == "a_b"


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 5.0, 6.0), (1, 5.5, 5.6), (2, 1.0, 1.0), (2, None, 4.0)], "k int, lo double, hi double")
    assert sorted(map(tuple, intervals.islands(df, ["k"]).collect())) == [(1, 0, 3), (1, 5, 6), (2, 1, 1)]
    assert [tuple(r) for r in intervals.gaps(df, ["k"]).collect()] == [(1, 3, 5)]
    runs = intervals.runs(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, o int, v string"), ["k"], ["o"], "v")
    assert [r.run for r in runs.orderBy("o").collect()] == [1, 1, 2, 2, 3]


def test_components_and_nodes(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.component for x in network.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == label
    edges = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(10.6, 0.0), (20.0, 0.0)]), (3, [(20.0, 0.3), (11.2, 0.1)]), (4, None)], f"ord bigint, geometry {LINE}")
    out, nodes = network.nodes_from_edges(edges, "ord", 1.0)
    assert sorted((x.ord, x.u, x.v) for x in out.collect()) == [(1, 0, 1), (2, 1, 2), (3, 2, 1)]
    assert sorted(map(tuple, nodes.collect())) == [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 0.0)]


def test_chains_loops_and_backward(spark):
    at = {c: (10.0 * i, 0.0) for i, c in enumerate("abcde")} | {"x": (0.0, 50.0), "y": (10.0, 50.0), "z": (5.0, 60.0)}
    rows = [straight(1, "a", "b", at), straight(2, "b", "c", at), straight(3, "c", "d", at), straight(4, "d", "e", at), straight(5, "d", "a", at), straight(6, "x", "y", at), straight(7, "y", "z", at), straight(8, "z", "x", at)]
    df = spark.createDataFrame(rows, EDGE)
    got = {(x.u, x.v, x.edges, round(x.length, 3)) for x in network.contract_chains(df, attributes=["edge_level"]).collect()}
    # the ring x-y-z has no other node and stays; d has three ends
    assert ("d", "e", 1, 10.0) in got and ("d", "d", 4, 60.0) in got and len([g for g in got if g[0] in "xyz"]) == 3
    back = network.backward_edges(spark.createDataFrame([straight(1, "a", "b", at, oneway=False), straight(2, "b", "a", at), straight(3, "b", "c", at, oneway=None)], EDGE), "ord")
    assert sorted((x.u, x.v, x.ord) for x in back.collect()) == [("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("c", "b", 3)]
    loop = (1, "a", "a", 3, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)], 12.0, False, 1)
    two = [loop, (2, "a", "a", 4, loop[4], 12.0, True, 1), straight(3, "a", "b", at)]
    out, nodes = network.split_self_loops(spark.createDataFrame(two, EDGE))
    assert out.count() == 6 + 3 + 1 and sorted(x.node for x in nodes.collect()) == ["a_3_a", "a_3_b", "a_4_a", "a_4_b"]
    assert {round(x.length, 6) for x in out.where("u <> 'b' and v <> 'b'").collect()} == {4.0}


def test_turns(spark):
    at = {"o": (0.0, 0.0), "s": (0.0, -10.0), "n": (0.0, 10.0), "e": (10.0, 0.0), "w": (-10.0, 0.0)}
    rows = [straight(1, "s", "o", at)] + [straight(k, "o", d, at, level=k) for k, d in enumerate("nesw", 2)]
    t = {x.v_out: x for x in turns.build_turns(spark.createDataFrame(rows, EDGE)).where("u_in = 's'").collect()}
    assert {k: x.turn_direction for k, x in t.items()} == {"n": "straight", "e": "right", "s": "U", "w": "left"}
    assert {k: x.turn_proximity for k, x in t.items()} == {"n": "near", "w": "far", "e": "near", "s": "near"}
    assert {k: x.turn_across for k, x in t.items()} == {"n": True, "w": True, "e": False, "s": True}
    assert t["n"].turn_u == "o_in0" and t["n"].turn_v == "o_out0"


def test_routes_like_dijkstra(spark):
    r = random.Random(7)
    rows = [(str(r.randint(0, 30)), str(r.randint(0, 30)), k % 2, float(r.randint(1, 9))) for k in range(120)]
    edges = spark.createDataFrame(rows + [("0", "1", 0, None), (None, "2", 0, 1.0)], "u string, v string, key int, length double")
    net = {}
    for u, v, _, w in rows:
        net.setdefault(u, {})[v] = min(w, net.get(u, {}).get(v, 1e9))

    def cost(a, b):
        best, heap = {a: 0.0}, [(0.0, a)]
        while heap:
            d, n = heapq.heappop(heap)
            for m, w in net.get(n, {}).items():
                if d + w < best.get(m, 1e9):
                    best[m] = d + w
                    heapq.heappush(heap, (d + w, m))
        return best.get(b)

    pairs = [(str(r.randint(0, 30)), str(r.randint(0, 30))) for _ in range(40)] + [("0", "99"), ("99", "0")]
    df = spark.createDataFrame(pairs + pairs[:5], "origin string, destination string")
    for limit in (10_000, 0):
        got = {(x.origin, x.destination): x for x in routing.shortest_paths(df, edges, max_broadcast=limit).collect()}
        assert set(got) == set(pairs)
        for (a, b), x in got.items():
            expected = 0.0 if a == b and limit else cost(a, b)
            if limit or a in net or a != b:
                assert x.cost == expected, (a, b)
            if x.route and len(x.route) > 1:
                assert x.route[0] == a and x.route[-1] == b and sum(net[u][v] for u, v in zip(x.route, x.route[1:])) == x.cost


def test_routes_over_edges_without_cost(spark):
    r = random.Random(11)
    rows = [("s", "a", 5.0), ("a", "b", 0.0), ("b", "a", 0.0), ("b", "c", 1.0)]
    for _ in range(60):
        u, v, w = str(r.randint(0, 14)), str(r.randint(0, 14)), float(r.choice([0, 0, 0.1, 0.2, 0.3]))
        rows += [(u, v, w), (v, u, w)]
    edges = spark.createDataFrame(rows, "u string, v string, length double")
    names = ["s", "a", "b", "c", *map(str, range(15))]
    pairs = spark.createDataFrame([(a, b) for a in ("s", "0", "1") for b in names], "origin string, destination string")
    near, spread = ({(x.origin, x.destination): (x.cost, x.route) for x in routing.shortest_paths(pairs, edges, max_broadcast=limit).collect()} for limit in (10_000, 0))
    assert near == spread
    assert near["s", "c"] == (6.0, ["s", "a", "b", "c"])
    assert all(len(set(route)) == len(route) for _, route in near.values() if route)


def test_spatial_like_brute_force(spark):
    r = random.Random(5)
    a = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(80)]
    b = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)]
    da, db = (spark.createDataFrame(x, "id bigint, x double, y double") for x in (a, b))
    got = {}
    for x in spatial.nearest_points(da, db, 3, 4.0).collect():
        got.setdefault(x.a_id, []).append((x.distance, x.b_id))
    for i, x, y in a:
        near = sorted((((x - p) ** 2 + (y - q) ** 2) ** 0.5, j) for j, p, q in b)[:3]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]
    assert spatial.nearest_points(da, db.limit(0), 3, 4.0).count() == 0
    few = spatial.nearest_points(da.limit(1), db.limit(2), 5, 1.0)
    assert few.count() == 2


def test_conflation(spark):
    t = [(1, [(0.0, 0.0), (100.0, 0.0)], "Main St"), (2, [(0.0, 50.0), (100.0, 50.0)], None), (3, None, None), (4, [(0.0, 90.0), (0.0, 90.0)], None)]
    m = [(11, [(0.0, 2.0), (100.0, 2.0)], "main street"), (12, [(0.0, 4.0), (100.0, 4.0)], "x"), (13, [(0.0, 52.0), (40.0, 52.0)], "y"), (14, [(50.0, -50.0), (50.0, 49.0)], "cross")]
    dt, dm = spark.createDataFrame(t, f"id bigint, geometry {LINE}, name string"), spark.createDataFrame(m, f"id bigint, geometry {LINE}, label string")
    mid = {x.id: x for x in conflate.match_by_midpoint(dt, dm, 10.0, azimuth_tolerance=20.0, fields=True).collect()}
    assert mid[1].match_id == 11 and mid[1].match_dist == 2 and mid[1].label == "main street" and mid[2].match_id is None and len(mid) == 4
    stats = {x.id: x for x in conflate.match_by_midpoint(dt, dm, 10.0, azimuth_tolerance=20.0, stats=True).collect()}
    assert stats[2].match_id is None and stats[2].match_azimuth == 90
    rows = conflate.match_by_hausdorff(dt, dm, 5.0, stats=True).collect()
    kinds = sorted((x.id, x.match_id or 0, x.match_type or "", round(x.t_hi - x.t_lo, 3) if x.t_hi else 0) for x in rows)
    assert kinds == [(1, 11, "1:1", 100), (1, 12, "1:1", 100), (2, 0, "", 60), (2, 13, "1:n", 40), (3, 0, "", 0), (4, 0, "", 0)]
    best = conflate.match_by_hausdorff(dt, dm, 5.0, closest_match=True, strings=("name", "label")).where("id = 1").collect()
    assert [x.match_id for x in best] == [11] and best[0].name_score > 0.9
    # two targets beside one match feature: the nearer keeps it, the other keeps its row
    pair = spark.createDataFrame([(1, t[0][1]), (5, [(0.0, 5.0), (100.0, 5.0)])], f"id bigint, geometry {LINE}")
    only = spark.createDataFrame([m[0][:2]], f"id bigint, geometry {LINE}")
    shared = {x.id: x.match_id for x in conflate.match_by_hausdorff(pair, only, 5.0, closest_target=True).collect()}
    assert shared == {1: 11, 5: None}
    assert conflate.match_by_hausdorff(dt.limit(0), dm, 5.0).count() == 0


def test_buildings_and_connection(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0, [(0.0, 0.0), (100.0, 0.0)], 100.0, True, 1), (2, "b", "a", 0, [(100.0, 0.0), (0.0, 0.0)], 100.0, True, 1), (3, "p", "q", 0, None, None, True, 1)], EDGE)
    box = lambda x, y: [[(x, y), (x + 4, y), (x + 4, y + 4), (x, y + 4)]]
    homes = spark.createDataFrame([(7, box(10.0, 5.0)), (8, box(30.0, 8.0)), (9, box(50.0, 15.0)), (10, box(20.0, -10.0)), (11, None)], f"id bigint, geometry array<{LINE}>")
    got = {x.ord: x for x in buildings.nearby_buildings(edges, homes, 20.0, 5.0).collect()}
    assert got[1].l_buildings == [7, 8] and got[1].l_distance == 10 and got[1].r_buildings == [10] and got[1].r_distance == 11
    assert got[2].r_buildings == [7, 8] and 3 not in got
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0)], "node string, x double, y double")
    points = spark.createDataFrame([(1, "s", 40.0, 3.0), (2, "t", 0.2, 0.1), (3, "far", 500.0, 500.0)], "id bigint, name string, x double, y double")
    new_nodes, joined, aliases = connect.connect_points(points, nodes, edges, 20.0)
    assert {(x.name, x.node) for x in aliases.collect()} == {("s", "s"), ("t", "a"), ("far", None)}
    ways = {(x.u, x.v): round(x.length, 3) for x in joined.where("length is not null").collect()}
    assert ways[("s", "s_link")] == 3 and ways[("a", "s_link")] == 40 and ways[("b", "s_link")] == 60 and ("a", "b") not in ways
    assert {x.node for x in new_nodes.collect()} == {"a", "b", "s", "s_link"}
    pairs = spark.createDataFrame([("s", (40.0, 3.0), "t", (0.2, 0.1)), ("s", (40.0, 3.0), "far", (500.0, 500.0))], "a_name string, a_point struct<x:double,y:double>, b_name string, b_point struct<x:double,y:double>")
    trips = {x.b_name: x for x in connect.routes_between_points(pairs, nodes, edges, 20.0, summarize_links=True).collect()}
    assert trips["t"].status == "ok" and round(trips["t"].route_length, 3) == 43 and trips["far"].status == "unplaced"
    wide = {x.b_name: x for x in connect.routes_between_points(pairs, nodes, edges, 20.0, both_ways=True, wide=True).collect()}
    # without its link the way from s begins on the street; there may be no way back
    assert len(wide) == 2 and round(wide["t"].route_length, 3) == 40 and round(wide["t"].cost, 3) == 43 and {"rev_status", "rev_route_length"} <= set(wide["t"].asDict())


def test_sources(spark, tmp_path):
    for k, extra in ((1, 0), (2, 5)):
        (tmp_path / f"t{k}").mkdir()
        (tmp_path / f"t{k}" / "d.csv").write_text('geoid,B01,"B01, Error",B02\n14000US1,%d,2,3\n14000US2,4,5,6\n04000,7,8,9\n' % (1 + extra))
        (tmp_path / f"t{k}" / "m.json").write_text(json.dumps({"release": {"id": "r", "years": "2020", "name": "n"}, "tables": {f"T{k}": {"title": "x", "denominator_column_id": None, "universe": "u", "columns": {"B01": {"name": "Total:", "indent": 0}, "B02": {"name": "Men", "indent": 1}}}}}))
    (tmp_path / "none").mkdir()
    df = census.read_census(spark, str(tmp_path), suffix="table")
    assert df.columns == ["geoid", "Total_T1", "Men_T1", "Total_T2"] and df.count() == 2
    (tmp_path / "o.json").write_text(json.dumps({"version": 1, "elements": [{"type": "way", "id": 5, "tags": {"highway": "path"}}, {"type": "node", "id": 6, "lat": 1.0, "lon": 2.0}]}))
    elements = overpass.read_elements(spark, str(tmp_path / "o.json"))
    assert {(x.id, x.type) for x in elements.collect()} == {(5, "way"), (6, "node")}
    assert overpass.examine_tags(elements).collect()[0].elements == 1 and overpass.merge_elements(elements, elements).count() == 4
    lines = tables.shapes_to_frame(spark, [[(float(x), 0.0), (x + 5.0, 5.0)] for x in range(0, 100, 10)])
    tables.write_by_cells(lines, str(tmp_path / "cells"), F.col("geometry"), 20.0)
    assert {x.id for x in tables.read_window(spark, str(tmp_path / "cells"), 22.0, 0.0, 41.0, 3.0, 6.0, 20.0).collect()} == {2, 3, 4}
    assert tables.empty_frame(spark, {"a": "int"}, 2).count() == 2


def test_streams(spark, tmp_path):
    rows = [(1, 5.0, 5.0, "2024-01-01 00:00:10"), (2, 25.0, 5.0, "2024-01-01 00:00:50"), (3, 6.0, 6.0, "2024-01-01 00:02:00"), (4, 7.0, 7.0, "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "id int, x double, y double, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, x double, y double, at timestamp").parquet(str(tmp_path / "in"))
    areas = spark.createDataFrame([(9, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]])], f"id bigint, geometry array<{LINE}>")
    lines = spark.createDataFrame([(8, [(0.0, 4.0), (30.0, 4.0)])], f"id bigint, geometry {LINE}")
    for name, df, mode in (("near", positions.positions_near_lines(stream, lines, 1.5), "append"), ("held", positions.counts_in_areas(stream, areas, 16.0, "at", "1 minute", "5 minutes"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(x.id, x.line_id, x.distance) for x in spark.table("near").collect()} == {(1, 8, 1.0), (2, 8, 1.0)}
    assert sorted(x.positions for x in spark.table("held").collect()) == [1, 1]
