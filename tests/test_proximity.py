import math
import random

import numpy as np

from wayloom.operators.proximity import PackedRTree, QuadTree, lines_near_areas

LINES = "ord bigint, geometry array<struct<x:double,y:double>>, leaf string"
AREAS = "bid bigint, geometry array<array<struct<x:double,y:double>>>, key string"


def _segment_point(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _cross(a, b, c, d):
    def o(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0


def _inside(p, rings):
    odd = False
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                odd = not odd
    return odd


def _distance(line, rings):
    if _inside(line[0], rings):
        return 0.0
    best = math.inf
    for a, b in zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]:
        for ring in rings:
            for c, d in zip(ring, ring[1:] + ring[:1]):
                if _cross(a, b, c, d):
                    return 0.0
                best = min(best, _segment_point(a, c, d), _segment_point(b, c, d), _segment_point(c, a, b), _segment_point(d, a, b))
    return best


def _made(seed, n_lines, n_areas, size):
    r = random.Random(seed)
    lines, areas = [], []
    for i in range(n_lines):
        x, y = r.uniform(0, size), r.uniform(0, size)
        n = r.choice([1, 2, 2, 3, 6])
        lines.append((i, [(x + r.uniform(-40, 40), y + r.uniform(-40, 40)) for _ in range(n)], "z"))
    for i in range(n_areas):
        x, y, w = r.uniform(0, size), r.uniform(0, size), r.choice([0.5, 10, 30, 200])
        shell = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        rings = [shell + shell[:1] if r.random() < 0.5 else shell]
        if w == 200:
            rings.append([(x + 50, y + 50), (x + 50, y + 150), (x + 150, y + 150), (x + 150, y + 50)])
        areas.append((i, [q[::-1] if r.random() < 0.5 else q for q in rings], "z"))
    return lines, areas


def test_like_brute_force(spark):
    lines, areas = _made(1, 300, 120, 1500)
    expected = {(i, j) for i, line, _ in lines for j, rings, _ in areas if _distance(line, rings) <= 12}
    more_lines = lines + lines[:50] + [(1000, None, "z"), (1001, [], "z"), (None, [(1.0, 1.0)], "z")]
    more_areas = areas + areas[:20] + [(1000, None, "z"), (1001, [[]], "z"), (1002, [], "z")]
    a, b = spark.createDataFrame(more_lines, LINES), spark.createDataFrame(more_areas, AREAS)
    for options in ({}, {"leaf_rows": 40}, {"leaf_rows": 10, "sample_rows": 60}):
        got = [tuple(r) for r in lines_near_areas(a, b, 12.0, "ord", "bid", **options).collect()]
        assert len(got) == len(set(got))
        assert set(got) == expected


def test_one_hot_spot(spark):
    lines = [(i, [(5.0, 5.0), (6.0, 5.0)], "z") for i in range(400)]
    areas = [(1, [[(8.0, 0.0), (9.0, 0.0), (9.0, 9.0)]], "z"), (2, [[(80.0, 0.0), (90.0, 0.0), (90.0, 9.0)]], "z")]
    a, b = spark.createDataFrame(lines, LINES), spark.createDataFrame(areas, AREAS)
    got = lines_near_areas(a, b, 12.0, "ord", "bid", leaf_rows=20)
    assert sorted(map(tuple, got.collect())) == [(i, 1) for i in range(400)]


def test_empty_tables(spark):
    lines, areas = _made(2, 5, 5, 50)
    a, b = spark.createDataFrame(lines, LINES), spark.createDataFrame(areas, AREAS)
    assert lines_near_areas(a.limit(0), b, 12.0, "ord", "bid").count() == 0
    assert lines_near_areas(a, b.limit(0), 12.0, "ord", "bid").count() == 0


def test_trees():
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 1000, (3000, 2))
    box = np.column_stack([low, low + rng.uniform(0, 20, (3000, 2))])
    query = box[:200] + np.array([-5, -5, 5, 5])
    i, j = PackedRTree(box).probe(query)
    expected = {(a, b) for a in range(200) for b in np.flatnonzero((box[:, 0] <= query[a, 2]) & (box[:, 2] >= query[a, 0]) & (box[:, 1] <= query[a, 3]) & (box[:, 3] >= query[a, 1]))}
    assert set(zip(i.tolist(), j.tolist())) == expected and len(i) == len(expected)
    tree = QuadTree.build(low, 50, 1.0)
    rows, leaves = tree.cover(box)
    assert (np.bincount(rows, minlength=3000) >= 1).all()
    own = tree.locate(low[:, 0], low[:, 1])
    assert set(zip(range(3000), own.tolist())) <= set(zip(rows.tolist(), leaves.tolist()))
