"""Angles, overlaps and other numbers, as plain column arithmetic.

Azimuths are mathematical: counter-clockwise from the x axis, in (-180, 180].
Null inputs give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.let import lit, point

TINY, GIANT = 2.2250738585072014e-308, 1.7976931348623157e308


def azimuth(x0: Column, y0: Column, x1: Column, y1: Column, degrees: bool = True) -> Column:
    """Direction from the first point to the second; equal points give 0."""
    angle = F.atan2(y1 - y0, x1 - x0)
    return F.degrees(angle) if degrees else angle


def normalize_azimuth(a: Column, zero_center: bool = False) -> Column:
    """Into 0..360 (360 stays), or with ``zero_center`` into (-180, 180]."""
    turned = F.when((a > 360) | (a < 0), F.pmod(a, F.lit(360.0))).otherwise(a)
    return F.when(turned > 180, turned - 360).otherwise(turned) if zero_center else turned


def azimuth_difference(a: Column, b: Column, directional: bool | str = True) -> Column:
    """True: 0..180; False or 'inverse': 0..90, either direction of a line; 'polar': turn from a to b in 0..360; 'signed': in (-180, 180]."""
    polar = normalize_azimuth(b - a)
    if directional == "polar":
        return polar
    if directional == "signed":
        return normalize_azimuth(b - a, zero_center=True)
    gap = F.pmod(F.abs(a - b), F.lit(360.0))
    full = F.least(gap, 360 - gap)
    return full if directional is True else F.least(full, 180 - full)


def degrees_centered_at_zero(d: Column) -> Column:
    """One turn off where beyond half a turn; -180 becomes 180."""
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def side_by_relative_angle(a: Column) -> Column:
    """'L' for a counter-clockwise angle, 'R' for a clockwise one, 'C' for none."""
    return F.when(a < 0, "R").when(a > 0, "L").when(a == 0, "C")


def float_overlap(min_a: Column, max_a: Column, min_b: Column, max_b: Column) -> Column:
    """Length that two intervals share, 0 for none."""
    low, high = F.greatest(min_a, min_b), F.least(max_a, max_b)
    known = min_a.isNotNull() & max_a.isNotNull() & min_b.isNotNull() & max_b.isNotNull()
    return F.when(known, F.greatest(high - low, F.lit(0.0)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "km") -> Column:
    """Great-circle distance in ``km`` (radius 6371) or ``mi`` (3956)."""
    radius = {"km": 6371.0, "mi": 3956.0}[unit]
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * F.asin(F.sqrt(a)) * radius


def line_by_azimuth(start: Column, length, angle, degrees: bool = True) -> Column:
    """The two-point line from ``start`` in a direction."""
    turned = F.radians(lit(angle)) if degrees else lit(angle)
    return F.array(start, point(start["x"] + F.cos(turned) * lit(length), start["y"] + F.sin(turned) * lit(length)))


def closest_point_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, constrain: bool = True) -> Column:
    """The nearest point of a segment (or of its whole line); of a segment without length, its start."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((px - ax) * dx + (py - ay) * dy) / size).when(size == 0, 0.0)
    if constrain:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return point(ax + t * dx, ay + t * dy)


def segment_intersection(a0: Column, a1: Column, b0: Column, b1: Column, on_a: bool = True, on_b: bool = True) -> Column:
    """Where two lines cross, null for parallels; on demand only where it lies within a segment's box."""
    ax, ay, bx, by = a1["x"] - a0["x"], a1["y"] - a0["y"], b1["x"] - b0["x"], b1["y"] - b0["y"]
    cross = ay * bx - ax * by
    t = F.when(cross != 0, (ay * (a0["x"] - b0["x"]) - ax * (a0["y"] - b0["y"])) / cross)
    x, y = b0["x"] + t * bx, b0["y"] + t * by

    def within(p: Column, q: Column) -> Column:
        return x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    keep = t.isNotNull()
    keep = keep & within(a0, a1) if on_a else keep
    keep = keep & within(b0, b1) if on_b else keep
    return F.when(keep, point(x, y))


def turn_direction(relative: Column, straight: float = 20.0) -> Column:
    """'straight', 'left', 'U' or 'right' from a turn angle in 0..360."""
    return (
        F.when((relative < straight) | (relative > 360 - straight), "straight")
        .when(relative <= 180 - straight, "left")
        .when(relative < 180 + straight, "U")
        .when(relative <= 360 - straight, "right")
    )


def hex_to_rgb(color: Column) -> Column:
    """Three whole numbers 0..255 of '#rrggbb', the mark being optional."""
    bare = F.regexp_replace(color, "^#", "")
    return F.array(*[F.conv(F.substring(bare, k, 2), 16, 10).cast("int") for k in (1, 3, 5)])


def rgb_to_dec(rgb: Column) -> Column:
    return F.transform(rgb, lambda v: v / F.lit(256.0))


def maps_url(lat: Column, lon: Column) -> Column:
    """A web map address centred on a position."""
    return F.concat(F.lit("https://maps.google.com/?ll="), F.round(lat, 5).cast("string"), F.lit(","), F.round(lon, 5).cast("string"))
