"""Areas as arrays of rings of points: measures and clipping in Column expressions.

Ring 0 is the shell, others are holes; rings may be open or closed and run
either way. Null areas give null, empty ones have no measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions.let import let, lit, point
from wayloom.functions.scalar import segment_intersection
from wayloom.session import checkpointed


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end."""
    a, z = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when((a["x"] == z["x"]) & (a["y"] == z["y"]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _sum(ring: Column, term) -> Column:
    return F.aggregate(L._pairs(closed(ring), term), F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    """Positive counter-clockwise; measured from the first point, which keeps far-off coordinates exact."""
    o = F.get(ring, F.lit(0))
    return F.when(F.size(ring) > 0, _sum(ring, lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])) / 2)


def area(poly: Column) -> Column:
    """The shell's area less the holes'."""
    holes = F.aggregate(F.slice(poly, 2, F.greatest(F.size(poly), F.lit(1))), F.lit(0.0), lambda s, ring: s + F.abs(F.coalesce(signed_area(ring), F.lit(0.0))))
    return F.when(F.size(poly) > 0, F.abs(signed_area(F.get(poly, F.lit(0)))) - holes)


def _moments(ring: Column, o: Column) -> Column:
    """(twice the area, and the moments about ``o``) of a ring, all positive-way round, in one pass."""
    def add(acc: Column, s: Column) -> Column:
        p, q = s["p"], s["q"]
        cross = (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
        return let(cross, lambda c: F.struct(
            (acc["a"] + c).alias("a"), (acc["x"] + (p["x"] + q["x"] - 2 * o["x"]) * c).alias("x"), (acc["y"] + (p["y"] + q["y"] - 2 * o["y"]) * c).alias("y")
        ))

    zero = F.struct(*[F.lit(0.0).alias(k) for k in "axy"])
    turned = lambda m: F.when(m["a"] < 0, F.struct((-m["a"]).alias("a"), (-m["x"]).alias("x"), (-m["y"]).alias("y"))).otherwise(m)
    return F.aggregate(L._pairs(closed(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), zero, add, turned)


def centroid(poly: Column) -> Column:
    """The centre of the area; of shapes without area, the mean of the shell's points."""
    shell = F.get(poly, F.lit(0))
    o = F.get(shell, F.lit(0))

    def less(acc: Column, m: Column) -> Column:
        return F.struct((acc["a"] - m["a"]).alias("a"), (acc["x"] - m["x"]).alias("x"), (acc["y"] - m["y"]).alias("y"))

    holes = F.transform(F.slice(poly, 2, F.greatest(F.size(poly), F.lit(1))), lambda ring: _moments(ring, o))
    total = F.aggregate(holes, _moments(shell, o), less)
    flat = lambda axis: F.aggregate(F.transform(shell, lambda p: p[axis]), F.lit(0.0), lambda s, v: s + v) / F.size(shell)
    centre = lambda m: F.when(F.abs(m["a"]) > 1e-12, point(o["x"] + m["x"] / (3 * m["a"]), o["y"] + m["y"] / (3 * m["a"]))).otherwise(point(flat("x"), flat("y")))
    return F.when(F.size(shell) > 0, let(total, centre))


def bounds(points: Column) -> Column:
    """(minx, miny, maxx, maxy) of an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def rectangle(minx, miny, maxx, maxy) -> Column:
    """The closed ring of a box, counter-clockwise from its lower left."""
    a, b, c, d = (lit(v).cast("double") for v in (minx, miny, maxx, maxy))
    return F.array(F.array(*[point(x, y) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]))


def contains(poly: Column, p: Column) -> Column:
    """Whether a point lies inside: an odd number of edges to its right, over all rings. Points
    on a left or lower edge count as inside, on a right or upper one not."""
    def crossings(ring: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
            at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(1.0) + a["x"]
            return F.when(spans & (p["x"] < at), 1).otherwise(0)

        return F.aggregate(L._pairs(closed(ring), one), F.lit(0), lambda s, x: s + x)

    return F.when(F.size(poly) >= 0, F.aggregate(poly, F.lit(0), lambda s, ring: s + crossings(ring)) % 2 == 1)


def cut_places(g: Column, poly: Column) -> Column:
    """Where a line meets an area's boundary, as sorted places along it."""
    def along(v: Column) -> Column:
        def of_segment(a: Column, b: Column) -> Column:
            hits = F.flatten(F.transform(poly, lambda ring: F.filter(L._pairs(closed(ring), lambda p, q: segment_intersection(a, b, p, q)), lambda x: x.isNotNull())))
            return F.transform(hits, lambda x: a["m"] + L.distance(a, x))

        return F.array_sort(F.array_distinct(F.flatten(L._pairs(v, of_segment))))

    return let(L.measured(g), along)


def _pieces(g: Column, poly: Column, inside: bool) -> Column:
    def keep(piece: Column) -> Column:
        middle = contains(poly, L.midpoint(piece))
        return (L.length(piece) > 1e-6) & (middle if inside else ~middle)

    return F.filter(L.split_at(g, cut_places(g, poly)), keep)


def clip_line(g: Column, poly: Column) -> Column:
    """The parts of a line inside an area, in order, as array<line>; none gives an empty array."""
    return F.when(g.isNotNull() & poly.isNotNull(), F.coalesce(_pieces(g, poly, True), F.array().cast("array<array<struct<x:double,y:double>>>")))


def outside_line(g: Column, poly: Column) -> Column:
    """The parts of a line outside an area."""
    return F.when(g.isNotNull() & poly.isNotNull(), F.coalesce(_pieces(g, poly, False), F.array().cast("array<array<struct<x:double,y:double>>>")))


def hexagon_grid(box: DataFrame, radius: float) -> DataFrame:
    """``row, col, geometry`` of pointed hexagons covering a one-row frame of (minx, miny, maxx, maxy).

    ``radius`` is the distance from the centre to a side. The extent is padded by
    one hexagon; even rows (the second, the fourth, ...) are shifted by half a
    width. Numbers of rows and columns are whole counts, not running sums.
    """
    import math

    side = 2 * radius * math.tan(math.pi / 6)
    half, wide, high, step = side * math.cos(math.radians(30)), 2 * side * math.cos(math.radians(30)), 2 * side, 1.5 * side
    rows = F.ceil((F.col("maxy") + high - (F.col("miny") - high)) / step).cast("int")
    r = box.select("*", F.explode(F.sequence(F.lit(0), rows - 1)).alias("row"))
    shift = F.when(F.col("row") % 2 == 1, F.lit(half)).otherwise(0.0)
    cols = F.ceil((F.col("maxx") + wide - (F.col("minx") - wide) - shift) / wide).cast("int")
    c = r.select("*", F.explode(F.sequence(F.lit(0), cols - 1)).alias("col"))
    x, y = F.col("minx") - wide + shift + F.col("col") * wide, F.col("miny") - high + F.col("row") * step
    corners = [(0, 0.5), (0, 1.5), (half, 2.0), (wide, 1.5), (wide, 0.5), (half, 0.0), (0, 0.5)]
    return c.select("row", "col", F.array(F.array(*[point(x + dx, y + dy * side) for dx, dy in corners])).alias("geometry"))


def random_points(poly_box: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``x, y`` of ``n`` points drawn evenly in the area of a one-row frame (``geometry``), by rejection in its box.

    As many are drawn as the area's share of its box lets expect, and then more
    until there are enough, however thin the area; an area of size 0, or none,
    has no points.
    """
    spark = poly_box.sparkSession
    box = bounds(F.get("geometry", F.lit(0)))
    shape = poly_box.where("geometry is not null").select("geometry", box.alias("b"), area(F.col("geometry")).alias("a")).limit(1)
    size = shape.select("a", ((F.col("b.maxx") - F.col("b.minx")) * (F.col("b.maxy") - F.col("b.miny"))).alias("box")).first()
    if n <= 0 or size is None or not size.a or size.a <= 0:
        return spark.createDataFrame([], "x double, y double")
    draws, shape = int(1.2 * n * size.box / size.a) + 100, F.broadcast(checkpointed(shape))
    out, got = None, 0
    while got < n:
        drawn = spark.range(draws).join(shape)
        p = drawn.select("geometry", (F.col("b.minx") + F.rand(seed) * (F.col("b.maxx") - F.col("b.minx"))).alias("x"), (F.col("b.miny") + F.rand(seed + 1) * (F.col("b.maxy") - F.col("b.miny"))).alias("y"))
        kept = checkpointed(p.where(contains(F.col("geometry"), point(F.col("x"), F.col("y")))).select("x", "y"))
        out, got, seed = kept if out is None else out.unionByName(kept), got + kept.count(), seed + 2
    return out.limit(n)
