"""Lines and areas cut against areas in numpy, many pairs at once.

Shapes lie in arrays of segments; a pair is two numbers of shapes. What is said of
pairs holds as in ``functions/polygon``, to the last vertex rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments against segments held at once.
BLOCK = 200_000


class Outlines:
    """The segments of lines, or of areas' closed rings; those of shape k are ``first[k]`` up to ``first[k] + count[k]``.

    Null and non-finite vertices are left out. ``start`` is each shape's first vertex.
    """

    def __init__(self, geometry: pa.Array | pa.ChunkedArray, rings: bool) -> None:
        g = geometry.combine_chunks() if isinstance(geometry, pa.ChunkedArray) else geometry
        n, sizes = len(g), _sizes(g)
        shape_of = np.arange(n)
        if rings:
            shape_of, g = np.repeat(shape_of, sizes), g.flatten()
            sizes = _sizes(g)
        part, points = np.repeat(np.arange(len(sizes)), sizes), g.flatten()
        xy = np.column_stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in (0, 1)]).astype(float).reshape(-1, 2)
        good = np.isfinite(xy).all(axis=1)
        self.xy, self.part = xy[good], part[good]
        self.shape_of, self.n = shape_of, n
        owner = shape_of[self.part]
        at = np.arange(len(self.xy))
        last = np.ones(len(at), dtype=bool)
        last[:-1] = self.part[1:] != self.part[:-1]
        if rings:
            head = np.searchsorted(self.part, self.part[last])
            following = at + 1
            following[last] = head
        else:
            at, following, owner = at[~last], at[~last] + 1, owner[~last]
        self.seg = np.column_stack([self.xy[at], self.xy[following]])
        self.count = np.bincount(owner, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        starts = np.searchsorted(shape_of[self.part], np.arange(n))
        self.start = np.full((n, 2), np.nan)
        there = starts < len(self.xy)
        self.start[there] = self.xy[starts[there]]
        self.long = np.hypot(self.seg[:, 2] - self.seg[:, 0], self.seg[:, 3] - self.seg[:, 1])
        total = np.concatenate([[0.0], np.cumsum(self.long)])
        self.m = total[:-1] - np.repeat(total[self.first], self.count) if n else total[:-1]
        self.total = np.bincount(owner, weights=self.long, minlength=n)
        self.ahead = total[:-1]


def _sizes(g: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(g), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of as many items as the counts add up to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(cost: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Runs of rows whose costs add up to about ``most``, at least a row each."""
    if len(cost) == 0:
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(cost) // most)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(cost)]):
        yield slice(int(lo), int(hi))


def crossings(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, segment of ``a``, place along it) wherever the outlines of a pair cross or touch; parallels don't."""
    nb = b.count[j]
    pair, k = expand(a.count[i] * nb)
    s, e = a.first[i][pair] + k // nb[pair], b.first[j][pair] + k % nb[pair]
    x0, y0, x1, y1 = a.seg[s].T
    u0, v0, u1, v1 = b.seg[e].T
    ax, ay, bx, by = x1 - x0, y1 - y0, u1 - u0, v1 - v0
    cross = ay * bx - ax * by
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ay * (x0 - u0) - ax * (y0 - v0)) / cross
        x, y = u0 + t * bx, v0 + t * by
        hit = cross != 0
        for p, lo, hi in ((x, x0, x1), (y, y0, y1), (x, u0, u1), (y, v0, v1)):
            hit &= (p >= np.minimum(lo, hi)) & (p <= np.maximum(lo, hi))
    return pair[hit], s[hit], np.hypot(x[hit] - x0[hit], y[hit] - y0[hit])


def inside(b: Outlines, j: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each point lies in its area: an odd number of edges to its right."""
    pair, k = expand(b.count[j])
    u0, v0, u1, v1 = b.seg[b.first[j][pair] + k].T
    x, y = p[pair, 0], p[pair, 1]
    spans = (v0 > y) != (v1 > y)
    pair, x, y, u0, v0, u1, v1 = (c[spans] for c in (pair, x, y, u0, v0, u1, v1))
    right = x < (u1 - u0) * (y - v0) / (v1 - v0) + u0
    return np.bincount(pair[right], minlength=len(j)) % 2 == 1


def lines_meet(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each line begins in the area or meets its outline."""
    met = np.zeros(len(i), dtype=bool)
    for at in blocks(1 + a.count[i] * b.count[j]):
        met[at] = inside(b, j[at], a.start[i[at]])
        rest = np.flatnonzero(~met[at]) + at.start
        met[rest[crossings(a, b, i[rest], j[rest])[0]]] = True
    return met


def areas_meet(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two areas share a point: one begins in the other, or the outlines meet."""
    met = np.zeros(len(i), dtype=bool)
    for at in blocks(1 + a.count[i] * b.count[j]):
        met[at] = inside(b, j[at], a.start[i[at]]) | inside(a, i[at], b.start[j[at]])
        rest = np.flatnonzero(~met[at]) + at.start
        met[rest[crossings(a, b, i[rest], j[rest])[0]]] = True
    return met


def any_met(a: Outlines, b: Outlines, a_box: np.ndarray, b_box: np.ndarray, meet) -> np.ndarray:
    """Of each shape of ``a`` whether it meets any of ``b``; those that have met one are asked no more."""
    met, lo, wide = np.zeros(a.n, dtype=bool), 0, 4
    while lo < b.n:
        hi = min(b.n, lo + wide)
        waiting = np.flatnonzero(~met)
        for at in blocks(np.full(len(waiting), hi - lo), 10 * BLOCK):
            i, j = boxes_meet(a_box[waiting[at]], b_box[lo:hi])
            i, j = waiting[at][i], j + lo
            met[i[meet(a, b, i, j)]] = True
        lo, wide = hi, 2 * wide
    return met


def boxes_meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = a[:, None, 0] <= b[None, :, 2]
    ok &= a[:, None, 2] >= b[None, :, 0]
    ok &= a[:, None, 1] <= b[None, :, 3]
    ok &= a[:, None, 3] >= b[None, :, 1]
    return np.nonzero(ok)


def box_pairs(a: np.ndarray, b: np.ndarray, cell: float, cx: int, cy: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes that meet and whose shared lower left corner lies in the cell."""
    for at in blocks(np.full(len(a), len(b)), 10 * BLOCK):
        i, j = boxes_meet(a[at], b)
        i = i + at.start
        own = (np.floor(np.maximum(a[i, 0], b[j, 0]) / cell) == cx) & (np.floor(np.maximum(a[i, 1], b[j, 1]) / cell) == cy)
        yield i[own], j[own]


def _at(a: Outlines, i: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, segment) of each line at a place."""
    s = np.searchsorted(a.ahead, a.ahead[a.first[i]] + place, side="right") - 1
    s = np.clip(s, a.first[i], a.first[i] + a.count[i] - 1)
    long = a.long[s]
    t = np.clip((place - a.m[s]) / np.where(long > 0, long, 1.0), 0.0, 1.0)[:, None]
    return a.seg[s, :2] + t * (a.seg[s, 2:] - a.seg[s, :2]), s


def pieces(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray, within: bool, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, lo, hi) of the stretches of each line inside its area, or outside, in order; those up to ``least`` long don't count."""
    out = []
    for at in blocks(1 + a.count[i] * b.count[j]):
        ii, jj = i[at], j[at]
        pair, s, along = crossings(a, b, ii, jj)
        real = np.flatnonzero(a.count[ii] > 0)
        total = a.total[ii]
        pair = np.concatenate([real, pair, real])
        place = np.concatenate([np.zeros(len(real)), np.clip(a.m[s] + along, 0.0, total[pair[len(real) : len(pair) - len(real)]]), total[real]])
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        keep = (pair[1:] == pair[:-1]) & (place[1:] - place[:-1] > least)
        pair, lo, hi = pair[:-1][keep], place[:-1][keep], place[1:][keep]
        middle, _ = _at(a, ii[pair], (lo + hi) / 2)
        kept = inside(b, jj[pair], middle) == within
        out.append((pair[kept] + at.start, lo[kept], hi[kept]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=int), np.zeros(0), np.zeros(0))


def stretches(a: Outlines, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The lines between two places, as an array of lines."""
    (p, s), (q, e) = _at(a, i, lo), _at(a, i, hi)
    owner, k = expand(np.maximum(e - s, 0) + 2)
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, dtype=bool)
    mid = (k > 0) & ~last
    xy = np.where((k == 0)[:, None], p[owner], q[owner])
    xy[mid] = a.seg[s[owner[mid]] + k[mid], :2]
    m = np.where(k == 0, -np.inf, np.inf)
    m[mid] = a.m[s[owner[mid]] + k[mid]]
    keep = ~mid | ((m > lo[owner]) & (m < hi[owner]))
    return line_array(xy[keep], np.bincount(owner[keep], minlength=len(i)))


def line_array(xy: np.ndarray, sizes: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), points)


#: Corners up to which a convex ring is cut whole; others are cut as the triangles of their fan.
WHOLE = 8


class Parts:
    """Areas as signed convex parts, all with the same number of corners (the last repeated): shape k has ``first[k]`` up to ``first[k] + count[k]``."""

    def __init__(self, shapes: Outlines) -> None:
        n = np.bincount(shapes.part, minlength=len(shapes.shape_of))
        start = np.cumsum(n) - n
        ring = np.flatnonzero(n > 0)
        shut = (shapes.xy[start[ring]] == shapes.xy[start[ring] + n[ring] - 1]).all(axis=1) & (n[ring] > 1)
        n[ring[shut]] -= 1
        hole = np.arange(len(n)) > np.searchsorted(shapes.shape_of, shapes.shape_of)
        owner, sign, corners = [], [], []

        def add(rings: np.ndarray, xy: np.ndarray, positive: np.ndarray) -> None:
            owner.append(shapes.shape_of[rings])
            sign.append(np.where(hole[rings], -1.0, 1.0) * np.where(positive, 1.0, -1.0))
            corners.append(xy)

        for size in np.unique(n[n > 2]):
            rings = np.flatnonzero(n == size)
            xy = shapes.xy[start[rings][:, None] + np.arange(size)]
            turned = polygon_areas(xy) < 0
            xy[turned] = xy[turned, ::-1]
            fan = np.stack([np.repeat(xy[:, :1], size - 2, axis=1), xy[:, 1:-1], xy[:, 2:]], axis=2)
            tri = polygon_areas(fan.reshape(-1, 3, 2)).reshape(len(rings), size - 2)
            into, out_of = xy - np.roll(xy, 1, axis=1), np.roll(xy, -1, axis=1) - xy
            whole = (size <= WHOLE) & (into[..., 0] * out_of[..., 1] - into[..., 1] * out_of[..., 0] >= 0).all(axis=1) & (tri >= 0).all(axis=1)
            add(rings[whole], xy[whole], np.ones(int(whole.sum()), dtype=bool))
            k, m = np.nonzero(~whole[:, None] & (tri != 0))
            t = fan[k, m]
            t[tri[k, m] < 0] = t[tri[k, m] < 0, ::-1]
            add(rings[k], t, tri[k, m] > 0)
        most = max((c.shape[1] for c in corners), default=3)
        corners = [np.concatenate([c, np.repeat(c[:, -1:], most - c.shape[1], axis=1)], axis=1) for c in corners]
        owner = np.concatenate([np.zeros(0, dtype=int), *owner])
        order = np.argsort(owner, kind="stable")
        self.xy, self.sign = np.concatenate([np.zeros((0, most, 2)), *corners])[order], np.concatenate([np.zeros(0), *sign])[order]
        self.count = np.bincount(owner, minlength=shapes.n)
        self.first = np.cumsum(self.count) - self.count
        self.area = np.bincount(owner[order], weights=self.sign * polygon_areas(self.xy), minlength=shapes.n)


def polygon_areas(xy: np.ndarray) -> np.ndarray:
    """Signed areas of polygons (rows) of as many corners each."""
    x, y = xy[..., 0] - xy[..., :1, 0], xy[..., 1] - xy[..., :1, 1]
    return (x[..., :-1] * y[..., 1:] - x[..., 1:] * y[..., :-1]).sum(axis=-1) / 2


def half_planes(xy: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Convex polygons (rows) cut to what lies left of or on their line from ``a`` to ``b``; corners that are missing repeat the first, of none all are 0."""
    d = b - a
    side = d[:, :1] * (xy[..., 1] - a[:, 1:]) - d[:, 1:] * (xy[..., 0] - a[:, :1])
    kept = side >= 0
    cut = np.flatnonzero(~kept.all(axis=1))
    if len(cut) == 0:
        return xy
    q, sq, iq = xy[cut], side[cut], kept[cut]
    p, sp, ip = np.roll(q, 1, axis=1), np.roll(sq, 1, axis=1), np.roll(iq, 1, axis=1)
    over = ip != iq
    t = sp / np.where(over, sp - sq, 1.0)
    corners = np.stack([p + t[..., None] * (q - p), q], axis=2).reshape(len(cut), -1, 2)
    there = np.stack([over, iq], axis=2).reshape(len(cut), -1)
    n = there.sum(axis=1)
    out = np.zeros((len(cut), max(int(n.max()), 1), 2))
    row, slot = np.nonzero(there)
    place = (np.cumsum(there, axis=1) - 1)[row, slot]
    out[row, place] = corners[row, slot]
    short = np.arange(out.shape[1]) >= n[:, None]
    out = np.where(short[..., None], out[:, :1], out)
    if len(cut) == len(xy):
        return out
    wide = max(out.shape[1], xy.shape[1])
    whole = np.concatenate([xy, np.repeat(xy[:, :1], wide - xy.shape[1], axis=1)], axis=1)
    whole[cut] = np.concatenate([out, np.repeat(out[:, :1], wide - out.shape[1], axis=1)], axis=1)
    return whole


def shared_areas(a: Parts, b: Parts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The area that each pair shares: shapes of any kind, as sums of signed convex parts."""
    total = np.zeros(len(i))
    for at in blocks(1 + a.count[i] * b.count[j], BLOCK // 8):
        nb = b.count[j[at]]
        pair, k = expand(a.count[i[at]] * nb)
        s, e = a.first[i[at]][pair] + k // nb[pair], b.first[j[at]][pair] + k % nb[pair]
        xy, tool = a.xy[s], b.xy[e]
        low, high = tool.min(axis=1), tool.max(axis=1)
        met = ((xy.max(axis=1) > low) & (xy.min(axis=1) < high)).all(axis=1)
        pair, s, e, xy, tool = (c[met] for c in (pair, s, e, xy, tool))
        for k in range(tool.shape[1]):
            xy = half_planes(xy, tool[:, k], tool[:, (k + 1) % tool.shape[1]])
        total[at] = np.bincount(pair, weights=a.sign[s] * b.sign[e] * np.abs(polygon_areas(xy)), minlength=len(nb))
    return total
