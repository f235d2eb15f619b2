import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions import cutting, regions, shapes
from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.operators import spatial

LINE = "array<struct<x:double,y:double>>"


def pts(xy):
    return [(float(x), float(y)) for x, y in xy]


def some_areas(r, n, spread=60):
    out = []
    for k in range(n):
        m = int(r.integers(3, 9))
        turn = np.sort(r.random(m)) * 2 * np.pi
        ring = np.column_stack([np.cos(turn), np.sin(turn)]) * r.uniform(3, 12, m)[:, None] + r.random(2) * spread
        rings = [pts(ring)]
        if k % 3 == 0:
            rings.append(pts(ring.mean(axis=0) + (ring - ring.mean(axis=0)) * 0.3))
        if k % 2 == 0:
            rings[0] = [*rings[0], rings[0][0]]
        out.append((k, rings))
    return [*out, (900, None), (901, [])]


@pytest.fixture(scope="module")
def sides(spark):
    r = np.random.default_rng(11)
    lines = [(k, pts(r.random(2) * 60 + np.cumsum(r.normal(0, 6, (int(r.integers(1, 6)), 2)), axis=0))) for k in range(150)]
    square = (950, [pts([(100, 100), (110, 100), (110, 110), (100, 110), (100, 100)])])
    lines += [(800, None), (801, []), (810, pts([(90, 100), (110, 120)])), (811, pts([(95, 105), (100, 105)])), (812, pts([(101, 101), (102, 102)])), (813, pts([(110, 95), (110, 99)]))]
    a, b = spark.createDataFrame(lines, f"id bigint, geometry {LINE}"), spark.createDataFrame([*some_areas(r, 60), square], f"id bigint, geometry array<{LINE}>")
    return a.cache(), b.cache()


def old_pairs(a, b, rings=False):
    box = spatial.box_of(F.get("geometry", F.lit(0)))
    return spatial.grid_join(a, b, box if rings else spatial.box_of(F.col("geometry")), box, 16.0)


def test_shapes_meeting_areas_as_column_expressions_have_it(sides):
    a, b = sides
    g, area = F.col("a.geometry"), F.col("b.geometry")
    met = old_pairs(a, b).where(F.when(P.contains(area, L.first(g)), True).otherwise(F.size(P.cut_places(g, area)) > 0))
    assert {r.id for r in spatial.lines_meeting_polygons(a, b, 16.0).collect()} == {r.id for r in met.select("a.id").collect()}
    left, right = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    first = lambda side: F.get(F.get(F.col(f"{side}.geometry"), F.lit(0)), F.lit(0))
    crosses = F.exists(g, lambda ring: F.size(P.cut_places(P.closed(ring), area)) > 0)
    met = old_pairs(left, right, rings=True).where(F.when(P.contains(area, first("a")) | P.contains(g, first("b")), True).otherwise(crosses))
    assert {r.id for r in spatial.areas_meeting_polygons(left, right, 16.0).collect()} == {r.id for r in met.select("a.id").collect()}


def test_a_crowded_cell_asks_each_shape_until_it_has_met(spark):
    """All shapes in one cell: 5 million pairs, of which few need to be looked at."""
    squares = spark.range(5_000).select("id", P.rectangle(F.col("id") % 50, F.col("id") % 40, F.col("id") % 50 + 3, F.col("id") % 40 + 3).alias("geometry"))
    asked = []
    real = spatial.cutting.areas_meet
    a = spatial.cutting.Outlines(squares.toArrow().column("geometry"), True)
    low = np.minimum.reduceat(a.seg[:, :2], a.first)
    box = np.column_stack([low, low + 3])
    met = spatial.cutting.any_met(a, a, box, box, lambda *x: asked.append(len(x[2])) or real(*x))
    assert met.all() and sum(asked) < 1_000_000
    assert spatial.areas_meeting_polygons(squares, squares.where("id < 1000"), 128.0).count() == 5_000


@pytest.mark.parametrize("within", [True, False])
def test_parts_of_lines_as_column_expressions_have_them(sides, within):
    a, b = sides
    cut = (P.clip_line if within else P.outside_line)(F.col("a.geometry"), F.col("b.geometry"))
    rows = old_pairs(a, b).select(F.col("a.id").alias("line_id"), F.col("b.id").alias("polygon_id"), F.posexplode(cut).alias("part", "geometry")).collect()
    want = {(r.line_id, r.polygon_id, r.part): np.array([(p.x, p.y) for p in r.geometry]) for r in rows}
    op = spatial.lines_in_polygons if within else spatial.lines_outside_polygons
    out = op(a, b, 16.0)
    assert out.columns == ["line_id", "polygon_id", "part", "geometry"]
    got = {(r.line_id, r.polygon_id, r.part): np.array([(p.x, p.y) for p in r.geometry]) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 30
    assert all(got[k].shape == want[k].shape and np.allclose(got[k], want[k], atol=1e-7) for k in want)
    long = {k: np.hypot(*np.diff(g, axis=0).T).sum() for k, g in want.items()}
    lengths = {(r.line_id, r.polygon_id, r.part): r.length for r in op(a, b, 16.0, give="length").collect()}
    assert lengths.keys() == long.keys() and all(abs(lengths[k] - long[k]) < 1e-7 for k in long)
    totals = {(r.line_id, r.polygon_id): r.length for r in op(a, b, 16.0, give="total").collect()}
    assert totals.keys() == {k[:2] for k in long} and abs(sum(totals.values()) - sum(long.values())) < 1e-5


def test_weights_of_areas_of_any_shape(sides):
    b = sides[1].withColumn("n", F.when(F.col("id") % 7 != 0, F.col("id") + 1)).withColumn("m", F.col("id") * 0.5)
    pairs = old_pairs(b, b, rings=True).select(F.col("a.id").alias("id"), F.col("b.n").alias("n"), F.col("b.m").alias("m"), shapes.overlap_area(F.col("a.geometry"), F.col("b.geometry")).alias("w"), P.area(F.col("b.geometry")).alias("s")).where("w > 0").collect()
    want = {}
    for r in pairs:
        e = want.setdefault(r.id, [0.0, 0.0, 0.0])
        e[0] += r.n * r.w / r.s if r.n is not None else 0.0
        e[1], e[2] = e[1] + r.m * r.w, e[2] + r.w
    got = {r.id: r for r in spatial.area_weighted(b, b.select("id", "geometry"), 16.0, extensive=["n"], intensive=["m"]).collect()}
    assert len(got) == b.count() and got[900].n is None and got[900].m is None and len(want) > 50
    assert all(abs((got[k].n or 0.0) - e[0]) < 1e-6 and abs(got[k].m - e[1] / e[2]) < 1e-6 for k, e in want.items())


def test_shared_areas_of_many_pairs_at_once(sides):
    b = sides[1].where("size(geometry) > 0").toArrow().column("geometry")
    parts = cutting.Parts(cutting.Outlines(b, True))
    i, j = (k.ravel() for k in np.meshgrid(*[np.arange(len(b))] * 2))
    rings = b.to_pylist()
    assert np.allclose(cutting.shared_areas(parts, parts, i, j), [shapes.shared_area(rings[x], rings[y]) for x, y in zip(i, j)], atol=1e-8)


def outline(rings):
    return None if rings is None else sum(shapes.ring_area(np.array(r)) for r in rings)


@pytest.mark.parametrize("cap", ["round", "flat", "square"])
def test_straight_lines_are_buffered_like_any(spark, cap, monkeypatch):
    r = np.random.default_rng(5)
    lines = [pts(r.random((2, 2)) * 50) for _ in range(30)] + [pts([(3, 3)]), pts([(1, 1), (1, 1)]), pts([(0, 0), (0, 0), (4, 1)]), pts([(0, 0), (5, 0), (5, 5)]), [], None]
    want = [None if not g else sum(shapes.ring_area(x) for x in regions.buffered([np.array(g)], 2.5, 8, cap)) for g in lines]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(lines)], f"id int, g {LINE}")
    got = {row.id: row.b for row in df.select("id", regions.buffer_line(F.col("g"), 2.5, cap=cap).alias("b")).collect()}
    assert all((got[k] is None) == (w is None) and (w is None or abs(outline(got[k]) - w) < 1e-5) for k, w in enumerate(want))
    assert all(ring[0] == ring[-1] for b in got.values() for ring in b or [])


def test_straight_lines_and_convex_areas_need_no_arrangement(spark):
    """200,000 shapes in one batch after another; by arrangements they'd take a quarter of an hour."""
    df = spark.range(200_000).select(F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y")), F.struct((F.col("id") + 9).cast("double").alias("x"), F.lit(1.0).alias("y"))).alias("g"), P.rectangle(F.col("id"), 0, F.col("id") + 9, 8).alias("p"))
    grown = lambda d: F.size(regions.buffer_area(F.col("p"), d))
    assert df.select(F.size(regions.buffer_line(F.col("g"), 1.0)).alias("l"), grown(2.0).alias("a"), grown(-2.0).alias("b"), grown(-4.5).alias("c")).groupBy("l", "a", "b", "c").count().collect() == [(1, 1, 1, 0, 200_000)]


def test_convex_areas_are_grown_and_shrunk_like_any(spark):
    r = np.random.default_rng(8)
    areas = []
    for k in range(60):
        turn = np.sort(r.random(int(r.integers(3, 9)))) * 2 * np.pi
        ring = np.column_stack([np.cos(turn) * r.uniform(1, 20), np.sin(turn) * r.uniform(4, 20)]) + r.random(2) * 1000
        areas.append([pts(ring if k % 2 else ring[::-1])])
    areas += [[pts([(0, 0), (9, 0), (9, 6), (0, 6), (0, 0)])], [pts([(0, 0), (9, 0), (9, 9), (5, 2), (0, 9)])], [pts([(0, 0), (20, 0), (20, 20), (0, 20)]), pts([(8, 8), (12, 8), (12, 12), (8, 12)])], [], None]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(areas)], f"id int, g array<{LINE}>")

    def by_arrangement(g, d):
        area = regions.region_of([np.array(x) for x in g])
        if not area:
            return 0.0
        edge = regions.buffered([np.vstack([x, x[:1]]) for x in area], abs(d), 8, area=area if d > 0 else ())
        return sum(shapes.ring_area(x) for x in (edge if d > 0 else regions.combine([area, edge], regions.RULES["difference"])))

    for d in (0.7, 3.0, -0.7, -3.0):
        got = {row.id: row.b for row in df.select("id", regions.buffer_area(F.col("g"), d).alias("b")).collect()}
        for k, g in enumerate(areas):
            assert (got[k] is None) == (g is None)
            assert g is None or abs(outline(got[k]) - by_arrangement(g, d)) < 1e-4, (k, d, g)


def test_overlays_of_many_pairs_are_those_of_each(sides):
    r = np.random.default_rng(2)
    grid = [[pts([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])] for x, y, w, h in r.integers(0, 6, (25, 4)) + np.array([0, 0, 1, 1])]
    frames = [[pts([(0, 0), (9, 0), (9, 9), (0, 9)]), pts([(2, 2), (7, 2), (7, 7), (2, 7)])], [pts([(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2)])]]
    rings = [[[tuple(p.values()) for p in ring] for ring in g] for g in sides[1].where("size(geometry) > 0").limit(25).toArrow().column("geometry").to_pylist()]
    for some in (grid + frames, rings):
        b = cutting.Outlines(cutting.pa.array([[[{"x": x, "y": y} for x, y in ring] for ring in g] for g in some]), True)
        i, j = (k.ravel() for k in np.meshgrid(*[np.arange(len(some))] * 2))
        hows = list(regions.RULES)
        for how, got in zip(hows, regions.overlays(b, b, i, j, hows)):
            for x, y, g in zip(i, j, got.to_pylist()):
                want = regions.combine([regions.region_of([np.array(q) for q in some[k]]) for k in (x, y)], regions.RULES[how])
                assert [len(q) for q in g] == [len(q) + 1 for q in want], (how, some[x], some[y])
                assert all(np.allclose([tuple(p.values()) for p in q][:-1], w, atol=1e-6) for q, w in zip(g, want))


def test_lines_in_a_crowd_are_asked_until_they_have_met():
    x = np.arange(4_000) % 63.0
    lines = cutting.line_array(np.column_stack([np.repeat(x, 2) + np.tile([0.0, 9.0], len(x)), np.repeat(x[::-1], 2)]), np.full(len(x), 2))
    squares = cutting.pa.array([[[{"x": k % 60 + dx, "y": k % 61 + dy} for dx, dy in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0))]] for k in range(2_000)])
    a, b = cutting.Outlines(lines, False), cutting.Outlines(squares, True)
    a_box, b_box = np.column_stack([a.seg[:, :2], a.seg[:, 2:]]), np.column_stack([b.start, b.start + 9])
    asked = []
    met = cutting.any_met(a, b, a_box, b_box, lambda *s: asked.append(len(s[2])) or cutting.lines_meet(*s))
    i, j = cutting.boxes_meet(a_box, b_box)
    every = np.zeros(a.n, dtype=bool)
    every[i[cutting.lines_meet(a, b, i, j)]] = True
    assert (met == every).all() and met.any() and 5 * sum(asked) < len(i)
