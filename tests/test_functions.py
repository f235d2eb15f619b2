import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import lists, names, polygon, regions, shapes, tags
from wayloom.functions import scalar as S

LINE = "array<struct<x:double,y:double>>"


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def xy(points):
    return [(round(p.x, 6), round(p.y, 6)) for p in points]


def test_angles(spark):
    rows = [0.0, 180.0, -180.0, 360.0, 540.0, -10.0, 20.0, 160.0, 200.0, 340.0, None]
    df = spark.createDataFrame([(r,) for r in rows], "a double")
    a = F.col("a")
    got = df.select("a", S.normalize_azimuth(a).alias("n"), S.degrees_centered_at_zero(a).alias("z"), S.side_by_relative_angle(a).alias("s"), S.turn_direction(S.normalize_azimuth(a)).alias("t")).collect()
    assert [r.n for r in got] == [0, 180, 180, 360, 180, 350, 20, 160, 200, 340, None]
    assert [r.z for r in got][1:3] == [180, 180] and got[-1].z is None
    assert [r.s for r in got][:3] == ["C", "L", "R"] and got[-1].s is None
    assert [r.t for r in got] == ["straight", "U", "U", "straight", "U", "straight", "left", "left", "right", "right", None]
    r = one(spark, "a double, b double", (10.0, 350.0), *[S.azimuth_difference(F.col("a"), F.col("b"), k) for k in (True, False, "polar", "signed")])
    assert list(r) == [20, 20, 340, -20]
    r = one(spark, "a double", (1.0,), S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), S.float_overlap(F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(5.0)))
    assert math.isclose(r[0], 6371 * math.pi / 180) and r[1] == 0


def test_line_kernel(spark):
    g = [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0)]
    c = F.col("g")
    r = one(spark, f"g {LINE}", (g,), L.length(c), L.midpoint(c), L.interpolate(c, 99.0), L.interpolate(c, -1.0), L.azimuth_at(c, 5.0), L.split_at(c, F.array(F.lit(5.0), F.lit(11.0))), L.stretch(c, 8.0, 2.5), L.extend(c, 5.0), L.shorten(c, 1.0), L.shorten(c, 7.0), L.spaced_places(c, 4.0, "point"), L.nearest(F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y")), c), L.merge_ordered(F.array(c, c)))
    assert r[0] == 11 and xy([r[1]]) == [(3, 4.5)] and xy([r[2]]) == [(3, 10)] and xy([r[3]]) == [(3, 9)]
    assert math.isclose(r[4], math.degrees(math.atan2(4, 3)))
    assert [round(sum(math.dist(a, b) for a, b in zip(xy(p), xy(p)[1:])), 6) for p in r[5]] == [5, 6, 0]
    assert xy(r[6])[0] == (3, 7) and xy(r[6])[-1] == (1.5, 2)
    assert xy(r[7])[0] == (-3, -4) and xy(r[7])[-1] == (3, 15)
    assert xy(r[8])[0] == (0.6, 0.8) and xy(r[8])[-1] == (3, 9)
    assert xy(r[9])[0] == (3, 6) and xy(r[9])[-1] == (2.4, 3.2)
    assert r[10] == [1.5, 5.5, 9.5] and (r[11].distance, r[11].place) == (2, 8)
    assert xy(r[12]) == [(0, 0), (3, 4), (3, 10), (0, 0), (3, 4), (3, 10)]
    empty = one(spark, f"g {LINE}", ([],), L.length(c), L.interpolate(c, 1.0), L.split_at(c, F.array(F.lit(1.0))))
    assert empty[0] == 0 and empty[1] is None and empty[2] is None
    null = one(spark, f"g {LINE}", (None,), L.length(c), L.midpoint(c), L.azimuth_at(c, 0.0))
    assert list(null) == [None] * 3


def test_line_properties(spark):
    r = random.Random(3)
    rows = [(i, [(r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(r.randint(2, 7))], sorted(r.uniform(0, 100) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(rows, f"id int, g {LINE}, d array<double>")
    c = F.col("g")
    pieces = F.aggregate(L.split_at(c, F.col("d")), F.lit(0.0), lambda s, p: s + L.length(p))
    got = df.select(L.length(c).alias("n"), pieces.alias("p"), L.length(L.reverse(c)).alias("b"), L.nearest(L.interpolate(c, F.col("d")[0]), c)["distance"].alias("on"), L.directed_hausdorff(c, c).alias("h")).collect()
    for x in got:
        assert math.isclose(x.n, x.p, abs_tol=1e-6) and math.isclose(x.n, x.b) and x.on < 1e-9 and x.h < 1e-9


def test_parallel_part(spark):
    a, b = [(10.0, 1.0), (20.0, 1.0)], [(0.0, 0.0), (50.0, 0.0)]
    r = one(spark, f"a {LINE}, b {LINE}", (a, b), L.parallel_part(F.col("a"), F.col("b")), L.parallel_part(F.col("b"), F.col("a")), L.segment_between(F.col("b"), F.get("a", F.lit(1)), F.get("a", F.lit(0))))
    assert xy(r[0]) == [(10, 0), (20, 0)] and r[1] is None and xy(r[2]) == [(20, 1), (10, 1)]


def test_polygons(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]
    g = [(-5.0, 5.0), (15.0, 5.0)]
    p = F.col("p")
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = one(spark, f"p array<{LINE}>, g {LINE}", (square, g), polygon.area(p), polygon.centroid(p), polygon.contains(p, at(5.0, 5.0)), polygon.contains(p, at(1.0, 5.0)), polygon.clip_line(F.col("g"), p), polygon.outside_line(F.col("g"), p))
    assert r[0] == 96 and xy([r[1]]) == [(5, 5)] and not r[2] and r[3]
    assert [xy(x) for x in r[4]] == [[(0, 5), (4, 5)], [(6, 5), (10, 5)]]
    assert [xy(x) for x in r[5]] == [[(-5, 5), (0, 5)], [(4, 5), (6, 5)], [(10, 5), (15, 5)]]


def test_shapes(spark):
    assert shapes.shared_area([[{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 4}, {"x": 2, "y": 1}, {"x": 0, "y": 4}]], [[{"x": 0, "y": 0}, {"x": 0, "y": 4}, {"x": 4, "y": 4}, {"x": 4, "y": 0}]]) == 10.0
    hole = [[{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 4}, {"x": 0, "y": 4}], [{"x": 1, "y": 1}, {"x": 3, "y": 1}, {"x": 3, "y": 3}, {"x": 1, "y": 3}]]
    assert abs(shapes.shared_area(hole, hole) - 12) < 1e-9
    parts = [np.array([[0, 0], [1, 0.0]]), np.array([[5, 5], [6, 6.0]]), np.array([[2, 0], [1, 0.0]])]
    merged = shapes.merge_parts(parts, 0.01)
    assert [m.tolist() for m in merged] == [[[0, 0], [1, 0], [2, 0]], [[5, 5], [6, 6]]]
    assert abs(shapes.axis_azimuth(np.array([[0, 0], [10, 10], [10, 12], [0, 2.0]])) - 45) < 20
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    areas = [[ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (2, 3))], [ring((0, 0), (4, 0), (0, 4))]]
    df = spark.createDataFrame([(areas[0], areas[1]), (areas[1], None)], f"a array<{LINE}>, b array<{LINE}>")
    got = [r[0] for r in df.select(shapes.overlap_area(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - (8 - 4 / 3)) < 1e-9 and got[1] is None
    many = spark.createDataFrame([([ring((0, 0), (1, 0), (2, 5)), ring((2, 5), (9, 9))],), ([],), (None,)], f"l array<{LINE}>")
    assert [None if r[0] is None else [len(x) for x in r[0]] for r in many.select(shapes.merge_multiline(F.col("l"))).collect()] == [[4], [], None]
    axes = one(spark, f"g {LINE}", ([(0.0, 0.0), (8.0, 0.0), (8.0, 2.0), (0.0, 2.0)],), shapes.major_minor_axes(F.col("g")))[0]
    assert abs(axes.major[0].y - 1) < 1e-9 and abs(axes.minor[0].x - 4) < 1e-9
    ring = one(spark, f"g {LINE}", ([(0.0, 0.0), (8.0, 0.0)],), regions.buffer_line(F.col("g"), 1.0))[0][0]
    assert abs(shapes.ring_area(np.array([(p.x, p.y) for p in ring])) - (16 + math.pi)) < 0.05


def test_tags(spark):
    values = ["30mph", "30 mph", "3 ft", "2 km", "", "yes", "5", ".5 m", "1 2 3", None, "7 cubits"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(None if x is None else round(x, 6) for x in r) for r in df.select(*[tags.parse_number(F.col("v"), k) for k in ("length", "distance", "speed")]).collect()]
    assert got == [(None,) * 3, (30, 30, 48.2802), (0.9144, 0.000914, 3), (2000, 2, 2), (None,) * 3, (None,) * 3, (5, 5, 5), (0.5, 0.0005, 0.5), (None,) * 3, (None,) * 3, (7, 7, 7)]
    elements = spark.createDataFrame(
        [(1, "way", {"cycleway:left": "lane", "oneway": "-1", "turn:lanes": "left|through;slight_right|right", "maxspeed": "30 mph", "maxspeed:forward": "60"}), (2, "node", {"highway": "stop"}), (3, "way", None), (4, "way", {})],
        "id int, type string, tags map<string,string>",
    )
    out = {r.id: r for r in tags.parse_tags(elements, ["bike_lane", "oneway", "right_turn_lanes", "speed_limit", "stop_sign"]).collect()}
    assert out[1].bike_lane and out[1].oneway and out[1].right_turn_lanes == 3 and out[1].speed_limit == 60 and out[1].stop_sign is None
    assert out[2].stop_sign and out[2].bike_lane is None and out[3].bike_lane is None and out[4].speed_limit is None


def test_names(spark):
    df = spark.createDataFrame([("north main street",), ("Elm",), ("Street",), ("  oak   GROVE Avenue ",), ("",), (None,)], "n string")
    got = [r[0] for r in df.select(names.standardize_streetname(F.col("n"))).collect()]
    assert got == ["N Main St", "Elm", "Street", "Oak Grove Ave", "", None]
    assert names.token_set_ratio("Main St N", "n main st") == 1.0 and names.token_set_ratio(None, "a") is None and names.token_set_ratio("", "a") == 0.0
    assert 0.3 < names.token_set_ratio("main street", "maine avenue") < 1


def test_lists(spark):
    r = one(spark, "a array<int>, i array<struct<lo:double,hi:double>>, m map<string,int>, n map<string,int>", ([3, 1, 3], [(5.0, 6.0), (1.0, 2.0), (2.0, 3.0), (0.0, 0.5)], {"a": 1}, {"a": 2, "b": 3}), lists.middle(F.col("a")), lists.drop_repeats(F.col("a")), lists.concatenate(F.col("a")), lists.unlistify(F.col("a")), lists.merge_intervals(F.col("i")), lists.merge_maps(F.col("m"), F.col("n")), lists.any_true(F.col("a")))
    assert r[0] == 1 and r[1] == [3, 1] and r[2] == "3, 1, 3" and r[3] is None and r[6]
    assert [tuple(x) for x in r[4]] == [(0, 0.5), (1, 3), (5, 6)] and r[5] == {"a": [1, 2], "b": [3]}
