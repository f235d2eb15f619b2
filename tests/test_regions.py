import math

import numpy as np
from pyspark.sql import functions as F

from wayloom.functions import regions
from wayloom.functions.regions import RULES, buffered, combine
from wayloom.functions.shapes import ring_area, shared_area
from wayloom.operators import spatial

AREA = "array<array<struct<x:double,y:double>>>"


def size(region):
    return sum(ring_area(r) for r in region)


def square(x, y, s):
    return [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)]


def test_overlay_of_touching_nested_and_equal_areas():
    how = lambda a, b: [round(size(combine([a, b], RULES[k])), 6) for k in ("intersection", "union", "difference", "symmetric_difference")]
    assert how(square(0, 0, 2), square(1, 1, 2)) == [1, 7, 3, 6]
    assert how(square(0, 0, 2), square(2, 0, 2)) == [0, 8, 4, 8]
    assert how(square(0, 0, 4), square(1, 1, 1)) == [1, 16, 15, 15]
    assert how(square(0, 0, 2), square(0, 0, 2)) == [4, 4, 0, 0]
    assert how(square(0, 0, 2), square(5, 5, 1)) == [0, 5, 4, 5]
    assert len(combine([square(0, 0, 2), square(2, 0, 2)], RULES["union"])) == 1
    assert combine([[], []], RULES["union"]) == []


def test_overlay_like_summed_triangles():
    r = np.random.default_rng(3)

    def shape():
        n = r.integers(4, 9)
        turn = (np.arange(n) + r.random(n) * 0.9) * 2 * np.pi / n
        return np.column_stack([np.cos(turn), np.sin(turn)]) * r.uniform(0.3, 2, n)[:, None] + r.integers(-1, 2, 2)

    for _ in range(120):
        a, b = shape(), shape()
        both = abs(shared_area(*[[[{"x": x, "y": y} for x, y in s]] for s in (a, b)]))
        assert abs(size(combine([[a], [b]], RULES["intersection"])) - both) < 1e-6
        assert abs(size(combine([[a], [b]], RULES["union"])) - (abs(ring_area(a)) + abs(ring_area(b)) - both)) < 1e-6


def test_buffers_of_bent_lines():
    bend = [np.array([(0, 0), (10, 0), (10, 10.0)])]
    corner = 1 - math.pi / 4
    assert abs(size(buffered(bend, 1, 64)) - (40 + math.pi - corner)) < 1e-2
    assert abs(size(buffered(bend, 1, 64, "flat")) - (40 - corner)) < 1e-2
    assert abs(size(buffered(bend, 1, 64, "square")) - (44 - corner)) < 1e-2
    ring = buffered([np.array([(0, 0), (10, 0), (10, 10.0), (0, 10), (0, 0)])], 1, 64)
    assert len(ring) == 2 and abs(size(ring) - (80 - 4 + math.pi)) < 1e-2
    assert abs(size(buffered([np.array([(3.0, 3.0)])], 2, 64)) - 4 * math.pi) < 1e-1 and buffered([np.array([(3.0, 3.0)])], 2, 8, "flat") == []


def test_columns_take_nulls_and_empties(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in p]
    a, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    df = spark.createDataFrame([([a, hole], [a]), ([a], None), ([], [a]), (None, None)], f"a {AREA}, b {AREA}")
    got = [r[0] for r in df.select(regions.overlay(F.col("a"), F.col("b"))).collect()]
    assert len(got[0]) == 2 and got[1] is None and got[2] == [] and got[3] is None
    grown = [r[0] for r in df.select(regions.buffer_area(F.col("a"), 0.5)).collect()]
    assert len(grown[0]) == 2 and grown[2] == [] and grown[3] is None
    assert [len(r[0]) for r in df.limit(1).select(regions.buffer_area(F.col("a"), -0.6)).collect()] == [0]


def test_crowded_cells(spark):
    """A third of both sides in one spot: dealt out into groups of bounded size, no pair lost or doubled."""
    rows = [(k, 5.0, 5.0) for k in range(300)] + [(1000 + k, 7.0 * (k % 30), 11.0 * (k // 30)) for k in range(600)]
    a = spark.createDataFrame(rows, "id bigint, x double, y double")
    whole = {(r.a_id, r.b_id) for r in spatial.points_within(a, a, 10.0).collect()}
    box = spatial._point_box(5.0)
    pairs = [(r.a.id, r.b.id) for r in spatial.grid_join(a, a, box, box, 16.0, hot_rows=40).select("a", "b").collect()]
    near = {(i, j) for i, x, y in rows for j, u, v in rows if abs(x - u) <= 10 and abs(y - v) <= 10}
    assert len(pairs) == len(set(pairs)) and set(pairs) == near and len(whole) <= len(near)
    cells = a.select("id", F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    joined = spatial.cell_join(cells, cells.withColumnRenamed("id", "other"), hot_rows=40)
    assert joined.count() == 900 * 900 and joined.select("id", "other").distinct().count() == 900 * 900


def test_nearest_points_leaves_nobody_out(spark):
    r = np.random.default_rng(7)
    b = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(r.random((400, 2)) * 50)] + [(900, 1e9, 0.0)]
    a = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(r.random((60, 2)) * 60)] + [(700, -1e9, 5.0), (701, None, 1.0)]
    left, right = (spark.createDataFrame(rows, "id bigint, x double, y double") for rows in (a, b))
    want = {i: [(j, round(d, 6)) for d, j in sorted((math.hypot(x - u, y - v), j) for j, u, v in b)[:3]] for i, x, y in a if x is not None}
    for few in (0, 5, 2000):
        if few == 0:
            left, want = left.where("id < 700"), {k: v for k, v in want.items() if k < 700}
        got = {}
        for row in spatial.nearest_points(left, right, 3, 2.0, few=few).orderBy("a_id", "rank").collect():
            got.setdefault(row.a_id, []).append((row.b_id, round(row.distance, 6)))
        assert got == want
    assert spatial.nearest_points(left, right.limit(0), 3, 2.0).count() == 0
