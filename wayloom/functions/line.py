"""Lines as ``array<struct<x,y>>``: measuring, cutting and comparing them in Column expressions.

Everything stays in the JVM. Distances along a line are called places. A null
line gives null; an empty one has no length and no places; vertices must not be
null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.let import let, lit, point
from wayloom.functions.scalar import azimuth, azimuth_difference


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def first(g: Column) -> Column:
    return F.get(g, F.lit(0))


def last(g: Column) -> Column:
    return F.get(g, F.size(g) - 1)


def reverse(g: Column) -> Column:
    return F.reverse(g)


def _pairs(g: Column, body) -> Column:
    """``body(vertex, next vertex)`` for each segment."""
    return F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), body)


def segments(g: Column) -> Column:
    """Two-point lines, one a segment."""
    return _pairs(g, lambda a, b: F.array(a, b))


def length(g: Column) -> Column:
    return F.aggregate(_pairs(g, distance), F.lit(0.0), lambda total, d: total + d)


def measures(g: Column) -> Column:
    """The place of each vertex."""
    return F.when(
        F.size(g) > 0,
        F.aggregate(_pairs(g, distance), F.array(F.lit(0.0)), lambda so_far, d: F.concat(so_far, F.array(F.element_at(so_far, -1) + d))),
    ).otherwise(F.array().cast("array<double>"))


def measured(g: Column) -> Column:
    """(x, y, m) of each vertex."""
    return F.zip_with(g, measures(g), lambda p, m: F.struct(p["x"].alias("x"), p["y"].alias("y"), m.alias("m")))


def _at(v: Column, place: Column) -> Column:
    """The point of measured vertices at a place."""
    total = F.element_at(v, -1)["m"]

    def between(d: Column) -> Column:
        k = F.greatest(F.lit(1), F.least(F.size(v) - 1, F.size(F.filter(v, lambda q: q["m"] <= d))))
        return let(
            F.struct(F.element_at(v, k).alias("a"), F.get(v, k).alias("b"), d.alias("d")),
            lambda s: let(
                F.when(s["b"]["m"] > s["a"]["m"], (s["d"] - s["a"]["m"]) / (s["b"]["m"] - s["a"]["m"])).otherwise(0.0),
                lambda t: point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])),
            ),
        )

    inside = F.greatest(F.lit(0.0), F.least(total, place))
    return F.when(F.size(v) > 1, let(inside, between)).when(F.size(v) == 1, point(F.element_at(v, 1)["x"], F.element_at(v, 1)["y"]))


def interpolate(g: Column, place) -> Column:
    """The point at a place; beyond an end, that end; a negative place counts from the end."""
    place = lit(place)
    return let(measured(g), lambda v: _at(v, F.when(place < 0, F.element_at(v, -1)["m"] + place).otherwise(place)))


def midpoint(g: Column) -> Column:
    return let(measured(g), lambda v: _at(v, F.element_at(v, -1)["m"] / 2))


def nearest(p: Column, g: Column) -> Column:
    """(distance, place, x, y) of the nearest point of a line; of equally near ones the first."""

    def of_segment(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / size))).otherwise(0.0)
        return let(
            F.struct(t.alias("t"), F.sqrt(size).alias("long")),
            lambda s: let(
                point(a["x"] + s["t"] * dx, a["y"] + s["t"] * dy),
                lambda q: F.struct(distance(p, q).alias("distance"), (a["m"] + s["t"] * s["long"]).alias("place"), q["x"].alias("x"), q["y"].alias("y")),
            ),
        )

    def whole(v: Column) -> Column:
        only = F.element_at(v, 1)
        alone = F.struct(distance(p, only).alias("distance"), F.lit(0.0).alias("place"), only["x"].alias("x"), only["y"].alias("y"))
        return F.when(F.size(v) > 1, F.array_min(_pairs(v, of_segment))).when(F.size(v) == 1, alone)

    return F.when(p.isNotNull() & (F.size(g) > 0), let(measured(g), whole))


def project(p: Column, g: Column) -> Column:
    return nearest(p, g)["place"]


def distance_to_line(p: Column, g: Column) -> Column:
    return nearest(p, g)["distance"]


def closest_point_along_line(p: Column, g: Column) -> Column:
    return let(nearest(p, g), lambda n: point(n["x"], n["y"]))


def azimuth_at(g: Column, place, degrees: bool = True) -> Column:
    """The direction of the segment that holds a place; a vertex belongs to the segment before it."""
    place = lit(place)

    def of(v: Column) -> Column:
        d = F.least(F.element_at(v, -1)["m"], place)
        k = F.greatest(F.lit(1), F.least(F.size(v) - 1, F.size(F.filter(v, lambda q: q["m"] < d))))
        return let(F.struct(F.element_at(v, k).alias("a"), F.get(v, k).alias("b")), lambda s: azimuth(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], degrees))

    return F.when(F.size(g) > 1, let(measured(g), of))


def line_azimuth(g: Column, degrees: bool = True) -> Column:
    """The direction from the first vertex to the last."""
    return azimuth(first(g)["x"], first(g)["y"], last(g)["x"], last(g)["y"], degrees)


def _cut(v: Column, lo: Column, hi: Column) -> Column:
    """The stretch of measured vertices between two places."""
    inner = F.transform(F.filter(v, lambda q: (q["m"] > lo) & (q["m"] < hi)), lambda q: point(q["x"], q["y"]))
    return F.concat(F.array(_at(v, lo)), inner, F.array(_at(v, hi)))


def stretch(g: Column, lo, hi) -> Column:
    """The part of a line between two places, turned round where the first is the farther."""
    lo, hi = lit(lo), lit(hi)
    return let(measured(g), lambda v: F.when(lo <= hi, _cut(v, lo, hi)).otherwise(F.reverse(_cut(v, hi, lo))))


def split_at(g: Column, places: Column) -> Column:
    """The pieces of a line cut at places (array<double>), in order; a cut at an end gives a piece without length."""

    def of(v: Column) -> Column:
        total = F.element_at(v, -1)["m"]
        inside = F.array_sort(F.transform(places, lambda d: F.greatest(F.lit(0.0), F.least(total, d))))
        return let(
            F.concat(F.array(F.lit(0.0)), inside, F.array(total)),
            lambda bounds: F.zip_with(
                F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda lo, hi: _cut(v, lo, hi)
            ),
        )

    return F.when(F.size(g) > 1, let(measured(g), of))


def split_at_points(g: Column, points: Column) -> Column:
    """The pieces of a line cut at the places nearest to points; the cut ends are the points as given."""

    def of(v: Column) -> Column:
        def placed(p: Column) -> Column:
            return F.struct(nearest(p, g)["place"].alias("m"), p["x"].alias("x"), p["y"].alias("y"))

        a, z = F.element_at(v, 1), F.element_at(v, -1)
        ends = [F.array(F.struct(q["m"].alias("m"), q["x"].alias("x"), q["y"].alias("y"))) for q in (a, z)]
        return let(
            F.concat(ends[0], F.array_sort(F.transform(points, placed)), ends[1]),
            lambda cuts: F.zip_with(
                F.slice(cuts, 1, F.size(cuts) - 1),
                F.slice(cuts, 2, F.size(cuts) - 1),
                lambda lo, hi: F.concat(
                    F.array(point(lo["x"], lo["y"])),
                    F.transform(F.filter(v, lambda q: (q["m"] > lo["m"]) & (q["m"] < hi["m"])), lambda q: point(q["x"], q["y"])),
                    F.array(point(hi["x"], hi["y"])),
                ),
            ),
        )

    return F.when(F.size(g) > 1, let(measured(g), of))


def segment_between(g: Column, u: Column, v: Column) -> Column:
    """The part of a line from point ``u`` to point ``v``, in that direction, with those points as ends."""
    return let(
        F.struct(project(u, g).alias("a"), project(v, g).alias("b")),
        lambda s: F.when(
            s["a"] <= s["b"], F.element_at(split_at_points(g, F.array(u, v)), 2)
        ).otherwise(F.reverse(F.element_at(split_at_points(g, F.array(u, v)), 2))),
    )


def linear_reference(g: Column, part: Column) -> Column:
    """(lo, hi): the places of a part's two ends along its parent line."""
    return F.struct(project(first(part), g).alias("lo"), project(last(part), g).alias("hi"))


def extend(g: Column, by, ends: str = "both") -> Column:
    """A line prolonged in the direction of its end segments; without a second vertex, or of repeated ones, unchanged there."""
    by = lit(by)

    def beyond(end: Column, inner: Column) -> Column:
        a = F.atan2(end["y"] - inner["y"], end["x"] - inner["x"])
        return point(end["x"] + F.cos(a) * by, end["y"] + F.sin(a) * by)

    before = F.array(beyond(first(g), F.get(g, F.lit(1)))) if ends in ("both", "start") else F.array().cast("array<struct<x:double,y:double>>")
    after = F.array(beyond(last(g), F.get(g, F.size(g) - 2))) if ends in ("both", "end") else F.array().cast("array<struct<x:double,y:double>>")
    return F.when(F.size(g) > 1, F.concat(before, g, after)).otherwise(g)


def shorten(g: Column, by, ends: str = "both") -> Column:
    """A line without its ends; where nothing would be left, the ends swap and the middle comes out turned round."""
    by = lit(by)
    lo = by if ends in ("both", "start") else F.lit(0.0)
    return let(length(g), lambda total: stretch(g, F.least(lo, total), F.greatest(F.lit(0.0), total - by if ends in ("both", "end") else total)))


def spaced_places(g: Column, spacing, centered: bool | str = False) -> Column:
    """Places every ``spacing``, ceil(length / spacing) of them: from the start, or with a
    point (True, 'point') or a gap ('space') at the middle. Past the end they stay at the end."""
    spacing = lit(spacing).cast("double")

    def of(total: Column) -> Column:
        if centered in (True, "point"):
            start = total / 2 - F.floor(total / 2 / spacing) * spacing
        elif centered == "space":
            start = (total - F.floor(total / spacing) * spacing) / 2
        else:
            start = F.lit(0.0)
        n = F.ceil(total / spacing).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: start + k * spacing)).otherwise(F.array().cast("array<double>"))

    return let(length(g), of)


def spaced_points(g: Column, spacing, centered: bool | str = False) -> Column:
    """(place, x, y) of points spaced along a line."""
    return let(
        measured(g),
        lambda v: F.transform(
            spaced_places(g, spacing, centered),
            lambda d: let(_at(v, d), lambda q: F.struct(d.alias("place"), q["x"].alias("x"), q["y"].alias("y"))),
        ),
    )


def split_evenly(g: Column, spacing, centered: bool | str = False, min_length: float = 0.0) -> Column:
    """The pieces of a line cut at spaced places ('end': a cut at the middle, 'segment': a piece
    at the middle). A first or last piece shorter than ``min_length`` joins its neighbour."""
    how = {"end": "point", "segment": "space"}.get(centered, centered)

    def of(total: Column) -> Column:
        inner = F.filter(spaced_places(g, spacing, how), lambda d: (d > 0) & (d < total))
        cuts = F.filter(inner, lambda d: (d >= min_length) & (total - d >= min_length))
        return split_at(g, cuts)

    return let(length(g), of)


def merge_ordered(lines: Column) -> Column:
    """The vertices of lines one after another; a vertex equal to the one before is dropped, gaps are bridged."""
    return let(
        F.flatten(lines),
        lambda v: F.filter(v, lambda p, i: (i == 0) | ((p["x"] != F.get(v, i - 1)["x"]) | (p["y"] != F.get(v, i - 1)["y"]))),
    )


def directed_hausdorff(a: Column, b: Column) -> Column:
    """How far the farthest vertex of ``a`` lies from ``b``."""
    return F.array_max(F.transform(a, lambda p: distance_to_line(p, b)))


def line_crossings(a: Column, b: Column) -> Column:
    """The points where two lines' segments cross, in order along ``a``."""
    from wayloom.functions.scalar import segment_intersection

    return F.flatten(
        _pairs(a, lambda p, q: F.filter(_pairs(b, lambda r, s: segment_intersection(p, q, r, s)), lambda x: x.isNotNull()))
    )


def split_at_crossings(a: Column, b: Column) -> Column:
    return split_at_points(a, line_crossings(a, b))


def parallel_part(a: Column, b: Column, max_distance: Column | None = None, snap: float | None = None) -> Column:
    """The piece of ``b`` that runs beside ``a``, or null.

    ``b`` is cut where the ends of ``a`` fall on it, unless that is farther than
    ``max_distance`` (by default the longer line), is an end of ``b``, or lies
    within ``snap`` of one; of the pieces the one that ``a`` strays least from is
    taken, if it has length. Without a cut there is none.
    """

    def of(s: Column) -> Column:
        limit = max_distance if max_distance is not None else F.greatest(length(a), s["total"])
        edge = F.lit(0.5e-6 if snap is None else max(snap, 0.5e-6))
        cuts = F.filter(
            F.array(nearest(first(a), b), nearest(last(a), b)), lambda n: (n["distance"] < limit) & (n["place"] > edge) & (n["place"] < s["total"] - edge)
        )
        pieces = split_at(b, F.transform(cuts, lambda n: n["place"]))
        scored = F.transform(pieces, lambda p, i: F.struct(directed_hausdorff(a, p).alias("stray"), i.alias("i"), p.alias("p")))
        best = F.array_min(scored)["p"]
        return F.when(F.size(cuts) > 0, let(best, lambda p: F.when(length(p) > 0, p)))

    return let(F.struct(length(b).alias("total")), of)


def undirected_gap(a: Column, b: Column) -> Column:
    return azimuth_difference(a, b, directional=False)
