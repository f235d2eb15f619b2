"""Geometry that Column expressions can't say well: Arrow UDFs over numpy, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def _arrow(of_row: Callable, kind: str, *columns: Column) -> Column:
    """``of_row`` over the columns' values as an Arrow UDF; null where any is null. (Through pandas, lists of
    lists of unequal length don't come in.)"""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(kind)
    arrow_type = to_arrow_type(schema)

    def batch(*arrays: pa.Array) -> pa.Array:
        rows = zip(*[a.to_pylist() for a in arrays])
        return pa.array([None if any(v is None for v in row) else of_row(*row) for row in rows], arrow_type)

    if len(columns) == 1:
        def one(a: pa.Array) -> pa.Array:
            return batch(a)

        return F.arrow_udf(one, schema)(*columns)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return batch(a, b)

    return F.arrow_udf(two, schema)(*columns)


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points if p is not None], dtype=float).reshape(-1, 2)


def _points(xy) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def hull(xy: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, by monotone chains."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def least_rectangle(xy: np.ndarray) -> np.ndarray | None:
    """Four corners of the rectangle of least area around points, or None where they lie on one line."""
    h = hull(xy)
    if len(h) < 3:
        return None
    best = None
    for edge in np.roll(h, -1, axis=0) - h:
        e = edge / np.hypot(*edge)
        n = np.array([-e[1], e[0]])
        a, b = h @ e, h @ n
        size = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or size < best[0] - 1e-12:
            best = size, np.array([a0 * e + b0 * n for a0, b0 in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return best[1]


def axes_of(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(major, minor) axis as two-point lines between the middles of opposite sides; of points on one line, that line and its middle twice."""
    if len(xy) == 0:
        return None
    box = least_rectangle(xy)
    if box is None:
        pts = np.unique(xy, axis=0)
        return np.array([pts[0], pts[-1]]), np.array([(pts[0] + pts[-1]) / 2] * 2)
    mid = (box + np.roll(box, -1, axis=0)) / 2
    across, along = np.array([mid[0], mid[2]]), np.array([mid[1], mid[3]])
    long_a, long_b = (np.hypot(*(x[1] - x[0])) for x in (across, along))
    return (along, across) if long_b >= long_a else (across, along)


def axis_azimuth(xy: np.ndarray) -> float | None:
    """The greater of the two azimuths of the longest side, in degrees."""
    axes = axes_of(xy)
    if axes is None:
        return None
    d = axes[0][1] - axes[0][0]
    return float(max(np.degrees(np.arctan2(d[1], d[0])), np.degrees(np.arctan2(-d[1], -d[0]))))


def major_axis_azimuth(points: Column) -> Column:
    """Azimuth of the long axis of an array of points; a two-point line needs no Python but gets it all the same."""
    return _arrow(lambda g: axis_azimuth(_xy(g)), "double", points)


def major_minor_axes(points: Column) -> Column:
    """(major, minor): the axes as lines."""
    def of(g):
        axes = axes_of(_xy(g))
        return None if axes is None else {"major": _points(axes[0]), "minor": _points(axes[1])}

    return _arrow(of, f"struct<major:{LINE},minor:{LINE}>", points)


def merge_parts(parts: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Lines joined end to end while any end lies within the tolerance of an end of the first; then the next, and so on."""
    left = [p for p in parts if len(p)]
    out = []
    while left:
        line = left.pop(0)
        joined = True
        while joined:
            joined = False
            for k, other in enumerate(left):
                for mine, theirs in ((-1, 0), (-1, -1), (0, -1), (0, 0)):
                    if np.hypot(*(line[mine] - other[theirs])) <= tolerance:
                        turned = other if (mine, theirs) in ((-1, 0), (0, -1)) else other[::-1]
                        line = np.concatenate([line, turned] if mine == -1 else [turned, line])
                        line = line[np.concatenate([[True], (np.diff(line, axis=0) != 0).any(axis=1)])]
                        left.pop(k)
                        joined = True
                        break
                if joined:
                    break
        out.append(line)
    return out


def merge_multiline(lines: Column, tolerance: float = 0.0) -> Column:
    """The lines of an array joined where their ends meet, turned round as needed."""
    return _arrow(lambda r: [_points(m) for m in merge_parts([_xy(g) for g in r if g is not None], tolerance)], f"array<{LINE}>", lines)


def clip_box(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a box, one side of the box after another."""
    for axis, limit, keep_less in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        if len(ring) == 0:
            break
        inside = ring[:, axis] <= limit if keep_less else ring[:, axis] >= limit
        out = []
        for k in range(len(ring)):
            p, q, a, b = ring[k - 1], ring[k], inside[k - 1], inside[k]
            if a != b:
                t = (limit - p[axis]) / (q[axis] - p[axis])
                out.append(p + t * (q - p))
            if b:
                out.append(q)
        ring = np.array(out).reshape(-1, 2)
    return ring


def quadrats(poly: Column, width: float) -> Column:
    """An area cut by a square grid: (col, row, geometry) of each piece, holes cut along."""
    def cut(rings) -> list[dict]:
        shapes = [_xy(r) for r in rings if r is not None and len(r)]
        if not shapes:
            return []
        low, high = np.floor(shapes[0].min(axis=0) / width).astype(int), np.floor(shapes[0].max(axis=0) / width).astype(int)
        out = []
        for i in range(low[0], high[0] + 1):
            for j in range(low[1], high[1] + 1):
                got = [clip_box(s, i * width, j * width, (i + 1) * width, (j + 1) * width) for s in shapes]
                if len(got[0]) > 2 and abs(ring_area(got[0])) > 1e-12:
                    out.append({"col": int(i), "row": int(j), "geometry": [_points(np.vstack([g, g[:1]])) for g in got if len(g) > 2]})
        return out

    return _arrow(cut, f"array<struct<col:int,row:int,geometry:array<{LINE}>>>", poly)


def ring_area(xy: np.ndarray) -> float:
    x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _clip_triangle(shape: np.ndarray, tri: np.ndarray) -> np.ndarray:
    for k in range(3):
        if len(shape) == 0:
            break
        a, b = tri[k], tri[(k + 1) % 3]
        side = (b[0] - a[0]) * (shape[:, 1] - a[1]) - (b[1] - a[1]) * (shape[:, 0] - a[0])
        out = []
        for m in range(len(shape)):
            p, q, sp, sq = shape[m - 1], shape[m], side[m - 1], side[m]
            if (sp >= 0) != (sq >= 0):
                out.append(p + sp / (sp - sq) * (q - p))
            if sq >= 0:
                out.append(q)
        shape = np.array(out).reshape(-1, 2)
    return shape


def _fan(rings) -> list[tuple[float, np.ndarray]]:
    """Signed triangles whose sum is the area: any simple shape, with holes against the shell."""
    out = []
    for k, ring in enumerate(rings):
        xy = _xy(ring)
        if len(xy) > 1 and (xy[0] == xy[-1]).all():
            xy = xy[:-1]
        if len(xy) < 3:
            continue
        turn = (1 if ring_area(xy) >= 0 else -1) * (1 if k == 0 else -1)
        for m in range(1, len(xy) - 1):
            tri = np.array([xy[0], xy[m], xy[m + 1]])
            a = ring_area(tri)
            if a:
                out.append((turn * np.sign(a), tri if a > 0 else tri[::-1]))
    return out


def shared_area(a, b) -> float:
    """The area that two shapes share, convex or not, with or without holes."""
    total = 0.0
    for sa, ta in _fan(a):
        low, high = ta.min(axis=0), ta.max(axis=0)
        for sb, tb in _fan(b):
            if (tb.min(axis=0) < high).all() and (tb.max(axis=0) > low).all():
                piece = _clip_triangle(ta, tb)
                if len(piece) > 2:
                    total += sa * sb * abs(ring_area(piece))
    return total


def overlap_area(a: Column, b: Column) -> Column:
    """``shared_area`` of two columns of areas."""
    return _arrow(shared_area, "double", a, b)
