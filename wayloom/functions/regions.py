"""Boolean operations on areas, and buffers, by one arrangement of segments.

All outlines are cut where they meet; of each piece it is asked what lies on its
left and on its right; pieces with the wanted area on one side only are its
outline. So shared and touching outlines need no rules of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from wayloom.functions.cutting import Outlines, expand, half_planes, line_array, polygon_areas
from wayloom.functions.shapes import LINE, _arrow, _points, _xy, ring_area

Region = list[np.ndarray]  # rings; a point is inside if it is inside an odd number of them


def region_of(rings) -> Region:
    """The rings of an area, open, without repeated points; those without area are left out."""
    out = []
    for ring in rings or []:
        xy = _xy(ring) if ring is not None and not isinstance(ring, np.ndarray) else ring
        if xy is None or len(xy) == 0:
            continue
        if (xy[0] == xy[-1]).all():
            xy = xy[:-1]
        xy = xy[np.concatenate([[True], (np.diff(xy, axis=0) != 0).any(axis=1)])] if len(xy) else xy
        if len(xy) > 2 and abs(ring_area(xy)) > 0:
            out.append(xy)
    return out


def _segments(region: Region) -> np.ndarray:
    return np.concatenate([np.column_stack([r, np.roll(r, -1, axis=0)]) for r in region]) if region else np.zeros((0, 4))


def _inside(p: np.ndarray, seg: np.ndarray) -> np.ndarray:
    if len(seg) == 0:
        return np.zeros(len(p), dtype=bool)
    x, y = p[:, :1], p[:, 1:]
    spans = (seg[:, 1] > y) != (seg[:, 3] > y)
    rise = np.where(seg[:, 3] == seg[:, 1], 1.0, seg[:, 3] - seg[:, 1])
    at = (seg[:, 2] - seg[:, 0]) * (y - seg[:, 1]) / rise + seg[:, 0]
    return (spans & (x < at)).sum(axis=1) % 2 == 1


def _cut(seg: np.ndarray, snap: float) -> np.ndarray:
    """Segments cut at every place where they cross or touch one another."""
    a, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    long = np.maximum(np.hypot(*d.T), 1e-150)
    low, high = np.minimum(seg[:, :2], seg[:, 2:]) - snap, np.maximum(seg[:, :2], seg[:, 2:]) + snap
    meet = (low[:, None, 0] <= high[None, :, 0]) & (low[None, :, 0] <= high[:, None, 0]) & (low[:, None, 1] <= high[None, :, 1]) & (low[None, :, 1] <= high[:, None, 1])
    i, j = np.nonzero(np.triu(meet, 1))
    cross = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    off = a[j] - a[i]
    apart = np.abs(cross) > 1e-12 * long[i] * long[j]
    safe = np.where(apart, cross, 1.0)
    t, u = (off[:, 0] * d[j, 1] - off[:, 1] * d[j, 0]) / safe, (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / safe
    ti, tj = snap / long[i], snap / long[j]
    hit = apart & (t >= -ti) & (t <= 1 + ti) & (u >= -tj) & (u <= 1 + tj)
    n = np.arange(len(seg))
    owners, places = [n, n, i[hit], j[hit]], [np.zeros(len(seg)), np.ones(len(seg)), t[hit], u[hit]]
    # ends that lie on another segment, as where outlines run along each other
    for own, other in ((i, j), (j, i)):
        for end in (0, 2):
            p = seg[other, end : end + 2] - a[own]
            s = (p * d[own]).sum(axis=1) / long[own] ** 2
            on = (np.abs(p[:, 0] * d[own, 1] - p[:, 1] * d[own, 0]) / long[own] <= snap) & (s > 0) & (s < 1)
            owners.append(own[on])
            places.append(s[on])
    owner, place = np.concatenate(owners), np.clip(np.concatenate(places), 0.0, 1.0)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    at = a[owner] + place[:, None] * d[owner]
    same = (owner[1:] == owner[:-1]) & (place[1:] > place[:-1])
    return np.column_stack([at[:-1][same], at[1:][same]])


def combine(regions: Sequence[Region], wanted: Callable[[np.ndarray], np.ndarray]) -> Region:
    """The area where ``wanted`` (of a table: point x region, inside or not) holds; shells counter-clockwise, holes clockwise, each shell before its holes."""
    own = [_segments(r) for r in regions]
    seg = np.concatenate(own) if own else np.zeros((0, 4))
    if len(seg) == 0:
        return []
    low = seg.reshape(-1, 2).min(axis=0)
    seg = seg - np.tile(low, 2)
    own = [s - np.tile(low, 2) for s in own]
    size = max(float(np.abs(seg).max()), 1e-9)
    snap = 1e-9 * size
    seg = np.round(_cut(seg, snap) / snap / 4) * snap * 4
    seg = seg[(seg[:, :2] != seg[:, 2:]).any(axis=1)]
    if len(seg) == 0:
        return []
    # each piece once, whichever way it was drawn
    flip = (seg[:, 0] > seg[:, 2]) | ((seg[:, 0] == seg[:, 2]) & (seg[:, 1] > seg[:, 3]))
    seg[flip] = seg[flip][:, [2, 3, 0, 1]]
    seg = seg[np.lexsort(seg.T)]
    seg = seg[np.concatenate([[True], (np.diff(seg, axis=0) != 0).any(axis=1)])]
    d = seg[:, 2:] - seg[:, :2]
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / np.hypot(*d.T)[:, None] * (64 * snap)
    middle = (seg[:, :2] + seg[:, 2:]) / 2
    left, right = (wanted(np.column_stack([_inside(middle + side * normal, s) for s in own])) for side in (1, -1))
    edge = seg[left != right]
    back = right[left != right]
    edge[back] = edge[back][:, [2, 3, 0, 1]]  # the area to the left
    return [r + low for r in _rings(edge)]


def _rings(edge: np.ndarray) -> Region:
    """Directed edges linked into rings, at a crossing turning as far left as can be, so that rings only touch."""
    ends = edge.tolist()
    starts: dict[tuple[float, float], list[int]] = {}
    for k, e in enumerate(ends):
        starts.setdefault((e[0], e[1]), []).append(k)
    used, rings = [False] * len(ends), []
    for first in range(len(ends)):
        ring, k = [], first
        while k is not None and not used[k]:
            used[k] = True
            x0, y0, x1, y1 = ends[k]
            ring.append((x0, y0))
            options = [n for n in starts.get((x1, y1), ()) if not used[n]]
            if len(options) > 1:
                hx, hy = x1 - x0, y1 - y0
                k = max(options, key=lambda n: math.atan2(hx * (ends[n][3] - y1) - hy * (ends[n][2] - x1), hx * (ends[n][2] - x1) + hy * (ends[n][3] - y1)))  # noqa: B023
            else:
                k = options[0] if options else None
        xy = np.array(ring)
        if len(xy) > 2:
            into, out_of = xy - np.roll(xy, 1, axis=0), np.roll(xy, -1, axis=0) - xy
            bent = np.abs(into[:, 0] * out_of[:, 1] - into[:, 1] * out_of[:, 0]) > 1e-12 * np.hypot(*into.T) * np.hypot(*out_of.T)
            xy = xy[bent]
        if len(xy) > 2 and abs(ring_area(xy)) > 0:
            rings.append(xy)
    shells = sorted((r for r in rings if ring_area(r) > 0), key=lambda r: r.min(axis=0).tolist())
    holes = [r for r in rings if ring_area(r) < 0]
    out: Region = []
    for shell in shells:
        out.append(shell)
        seg = _segments([shell])
        for hole in [h for h in holes if _inside((h[:1] + h[1:2]) / 2, seg)[0] or _inside(h.mean(axis=0)[None], seg)[0]]:
            if not any(hole is o for o in out):
                out.append(hole)
    return out


RULES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "intersection": lambda i: i.all(axis=1), "union": lambda i: i.any(axis=1), "difference": lambda i: i[:, 0] & ~i[:, 1:].any(axis=1), "symmetric_difference": lambda i: i.sum(axis=1) % 2 == 1,
}


def _closed(region: Region) -> list[list[dict]]:
    return [_points(np.vstack([r, r[:1]])) for r in region]


def overlay(a: Column, b: Column, how: str = "intersection") -> Column:
    """Two areas' intersection, union, difference or symmetric difference as an array of closed rings (empty for none).

    Shells run counter-clockwise and holes clockwise, so the result may have several
    shells, each followed by its holes; its area is the sum of signed areas.
    Null areas give null.
    """
    return _arrow(lambda x, y: _closed(combine([region_of(x), region_of(y)], RULES[how])), f"array<{LINE}>", a, b)


def _arranged(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, their pair, what lies on their left, on their right: in ``a``, in ``b``; each pair's lower left corner): ``combine`` of many pairs up to its rules."""
    (pa_, ka), (pb, kb) = expand(a.count[i]), expand(b.count[j])
    seg = np.concatenate([a.seg[a.first[i][pa_] + ka], b.seg[b.first[j][pb] + kb]])
    pair, side = np.concatenate([pa_, pb]), np.repeat([0, 1], [len(pa_), len(pb)])
    order = np.argsort(pair, kind="stable")
    order = order[(seg[order, :2] != seg[order, 2:]).any(axis=1)]
    seg, pair, side, n = seg[order], pair[order], side[order], len(i)
    count = np.bincount(pair, minlength=n)
    first = np.cumsum(count) - count
    low, size = np.zeros((n, 2)), np.full(n, 1e-9)
    some = np.flatnonzero(count)
    if len(some):
        low[some] = np.minimum(*(np.minimum.reduceat(seg[:, k : k + 2], first[some]) for k in (0, 2)))
        seg = seg - low[pair][:, [0, 1, 0, 1]]
        size[some] = np.maximum(np.maximum.reduceat(np.abs(seg).max(axis=1), first[some]), 1e-9)
    snap = 1e-9 * size
    own = snap[pair]
    # cut where they cross or touch, as in _cut
    at, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    long = np.maximum(np.hypot(*d.T), 1e-150)
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]) - own[:, None], np.maximum(seg[:, :2], seg[:, 2:]) + own[:, None]
    x, k = expand(count[pair])
    y = first[pair][x] + k
    x, y = x[y > x], y[y > x]
    meet = (lo[x] <= hi[y]).all(axis=1) & (lo[y] <= hi[x]).all(axis=1)
    x, y = x[meet], y[meet]
    cross, off = _turn(d[x], d[y]), at[y] - at[x]
    apart = np.abs(cross) > 1e-12 * long[x] * long[y]
    safe = np.where(apart, cross, 1.0)
    t, u = _turn(off, d[y]) / safe, _turn(off, d[x]) / safe
    tx, ty = own[x] / long[x], own[y] / long[y]
    hit = apart & (t >= -tx) & (t <= 1 + tx) & (u >= -ty) & (u <= 1 + ty)
    every = np.arange(len(seg))
    owners, places = [every, every, x[hit], y[hit]], [np.zeros(len(seg)), np.ones(len(seg)), t[hit], u[hit]]
    for mine, other in ((x, y), (y, x)):
        for end in (0, 2):
            p = seg[other, end : end + 2] - at[mine]
            s = (p * d[mine]).sum(axis=1) / long[mine] ** 2
            on = (np.abs(_turn(p, d[mine])) / long[mine] <= own[mine]) & (s > 0) & (s < 1)
            owners.append(mine[on])
            places.append(s[on])
    owner, place = np.concatenate(owners), np.clip(np.concatenate(places), 0.0, 1.0)
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    p = at[owner] + place[:, None] * d[owner]
    same = (owner[1:] == owner[:-1]) & (place[1:] > place[:-1])
    of = pair[owner[:-1][same]]
    piece = np.column_stack([p[:-1][same], p[1:][same]])
    piece = np.round(piece / snap[of, None] / 4) * snap[of, None] * 4
    real = (piece[:, :2] != piece[:, 2:]).any(axis=1)
    piece, of = piece[real], of[real]
    flip = (piece[:, 0] > piece[:, 2]) | ((piece[:, 0] == piece[:, 2]) & (piece[:, 1] > piece[:, 3]))
    piece[flip] = piece[flip][:, [2, 3, 0, 1]]
    order = np.lexsort((*piece.T, of))
    piece, of = piece[order], of[order]
    once = np.concatenate([[True], (np.diff(piece, axis=0) != 0).any(axis=1) | (of[1:] != of[:-1])]) if len(piece) else np.zeros(0, dtype=bool)
    piece, of = piece[once], of[once]
    e = piece[:, 2:] - piece[:, :2]
    normal = np.column_stack([-e[:, 1], e[:, 0]]) / np.hypot(*e.T)[:, None] * (64 * snap[of, None])
    middle = (piece[:, :2] + piece[:, 2:]) / 2
    q, k = expand(count[of])
    z = first[of][q] + k
    x0, y0, x1, y1 = seg[z].T
    sides = []
    for turn in (1, -1):
        m = middle + turn * normal
        px, py = m[q].T
        spans = (y0 > py) != (y1 > py)
        right = spans & (px < (x1 - x0) * (py - y0) / np.where(y1 == y0, 1.0, y1 - y0) + x0)
        sides.append((np.bincount(2 * q[right] + side[z[right]], minlength=2 * len(piece)) % 2 == 1).reshape(-1, 2))
    return piece, of, *sides, low


def _ring_arrays(edge: np.ndarray, pair: np.ndarray, low: np.ndarray) -> pa.Array:
    """``_rings`` of many pairs, closed; those whose rings touch, or with holes in one of several shells, are linked one by one."""
    n, many = len(low), len(edge)
    point, of = np.concatenate([edge[:, :2], edge[:, 2:]]), np.concatenate([pair, pair])
    order = np.lexsort((*point.T, of))
    new = np.concatenate([[False], (np.diff(point[order], axis=0) != 0).any(axis=1) | (np.diff(of[order]) != 0)]) if many else np.zeros(0, dtype=bool)
    name = np.empty(len(order), dtype=int)
    name[order] = np.cumsum(new)
    begin, end = name[:many], name[many:]
    outs = np.bincount(begin, minlength=len(order) + 1)
    plain = np.ones(n, dtype=bool)
    plain[pair[(outs[begin] != 1) | (outs[end] != 1)]] = False
    by_start = np.zeros(len(order) + 1, dtype=int)
    by_start[begin] = np.arange(many)
    following, used, walk, ring_of, ring = by_start[end].tolist(), (~plain[pair]).tolist(), [], [], 0
    for k in range(many):
        if not used[k]:
            while not used[k]:
                used[k] = True
                walk.append(k)
                ring_of.append(ring)
                k = following[k]
            ring += 1
    walk, ring_of = np.array(walk, dtype=int), np.array(ring_of, dtype=int)
    xy = edge[walk, :2]
    size = np.bincount(ring_of, minlength=ring)
    first = np.cumsum(size) - size
    nth = np.arange(len(walk)) - first[ring_of]
    into, out_of = xy - xy[first[ring_of] + (nth - 1) % size[ring_of]], xy[first[ring_of] + (nth + 1) % size[ring_of]] - xy
    bent = np.abs(_turn(into, out_of)) > 1e-12 * np.hypot(*into.T) * np.hypot(*out_of.T)
    xy, ring_of, whose = xy[bent], ring_of[bent], pair[walk[first]]
    size = np.bincount(ring_of, minlength=ring)
    first = np.cumsum(size) - size
    nth = np.arange(len(xy)) - first[ring_of]
    base = xy[first[ring_of]]
    area = np.bincount(ring_of, weights=_turn(xy - base, xy[first[ring_of] + (nth + 1) % size[ring_of]] - base), minlength=ring) / 2
    good = (size > 2) & (area != 0)
    shells, holes = (np.bincount(whose[good & s], minlength=n) for s in (area > 0, area < 0))
    plain &= (shells < 2) | (holes == 0)
    good &= plain[whose]
    corner = np.full((ring, 2), np.inf)
    np.minimum.at(corner, ring_of, xy)
    keep = np.flatnonzero(good)
    keep = keep[np.lexsort((np.where(area < 0, 0, corner[:, 1])[keep], np.where(area < 0, 0, corner[:, 0])[keep], area[keep] < 0, whose[keep]))]
    owner, k = expand(size[keep] + 1)
    at = first[keep][owner] + np.where(k == size[keep][owner], 0, k)
    rings = line_array(xy[at] + low[whose[keep]][owner], size[keep] + 1)
    quick = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose[keep], minlength=n))]).astype(np.int32)), rings)
    odd = np.flatnonzero(~plain)
    if len(odd) == 0:
        return quick
    order = np.argsort(pair, kind="stable")
    lo, hi = (np.searchsorted(pair[order], odd, side=s) for s in ("left", "right"))
    place = np.arange(n)
    place[odd] = n + np.arange(len(odd))
    return pa.concat_arrays([quick, pa.array([_closed([r + low[k] for r in _rings(edge[order[x:y]])]) for k, x, y in zip(odd, lo, hi)], quick.type)]).take(pa.array(place))


def overlays(a: Outlines, b: Outlines, i: np.ndarray, j: np.ndarray, hows: Sequence[str]) -> list[pa.Array]:
    """``overlay`` of many pairs by each rule, out of one arrangement."""
    piece, of, left, right, low = _arranged(a, b, i, j)
    out = []
    for how in hows:
        x, y = RULES[how](left), RULES[how](right)
        edge, back = piece[x != y], y[x != y]
        edge[back] = edge[back][:, [2, 3, 0, 1]]
        out.append(_ring_arrays(edge, of[x != y], low))
    return out


def _band(a: np.ndarray, b: np.ndarray, distance: float, corners: int, caps: tuple[bool, bool], square: tuple[bool, bool]) -> np.ndarray:
    """The outline around a segment, with a round or square cap at either end, or none."""
    d = b - a
    long = np.hypot(*d)
    e = d / long if long > 0 else np.array([1.0, 0.0])
    n = np.array([-e[1], e[0]])
    if square[0]:
        a = a - e * distance
    if square[1]:
        b = b + e * distance
    t = np.linspace(-np.pi / 2, np.pi / 2, 2 * corners + 1)[:, None]
    front = b + distance * (np.cos(t) * e + np.sin(t) * n) if caps[1] else np.array([b - distance * n, b + distance * n])
    rear = a - distance * (np.cos(t) * e + np.sin(t) * n) if caps[0] else np.array([a + distance * n, a - distance * n])
    return np.vstack([front, rear])


def buffered(parts: Sequence[np.ndarray], distance: float, corners: int = 8, cap: str = "round", area: Region = ()) -> Region:
    """All points at most ``distance`` from lines or points, and inside ``area``; arcs by ``corners`` a quarter circle."""
    bands = []
    for xy in parts:
        xy = xy[np.concatenate([[True], (np.diff(xy, axis=0) != 0).any(axis=1)])] if len(xy) else xy
        if len(xy) == 1:
            if cap != "flat":
                bands.append(_band(xy[0], xy[0], distance, corners, (cap == "round",) * 2, (cap == "square",) * 2))
            continue
        ring = len(xy) > 2 and (xy[0] == xy[-1]).all()
        for k in range(len(xy) - 1):
            ends = (k == 0 and not ring, k == len(xy) - 2 and not ring)
            bands.append(_band(xy[k], xy[k + 1], distance, corners, tuple(cap == "round" or not e for e in ends), tuple(cap == "square" and e for e in ends)))
    regions = [[b] for b in bands] + ([list(area)] if area else [])
    while len(regions) > 8:  # few at a time: what is cut against what grows with the square
        regions = [combine(regions[k : k + 8], RULES["union"]) for k in range(0, len(regions), 8)]
    return combine(regions, RULES["union"])


def _mixed(sizes: np.ndarray, xy: np.ndarray, rows: np.ndarray, slow: dict[int, list | None], n: int) -> pa.Array:
    """An array of ``n`` areas: those of ``rows`` have one open ring of ``sizes`` points each (none without points), the others are given by row."""
    kept = sizes > 0
    owner, k = expand(sizes + kept)
    at = (np.cumsum(sizes) - sizes)[owner] + np.where(k == sizes[owner], 0, k)
    ring = line_array(xy[at], (sizes + kept)[kept])
    quick = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), ring)
    if len(rows) == n and (rows == np.arange(n)).all():
        return quick
    place = np.full(n, -1)
    place[rows], place[list(slow)] = np.arange(len(rows)), len(rows) + np.arange(len(slow))
    return pa.concat_arrays([quick, pa.array(list(slow.values()), quick.type)]).take(pa.array(place, mask=place < 0))


def _turn(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v[..., 0] * w[..., 1] - v[..., 1] * w[..., 0]


def _bands(a: np.ndarray, b: np.ndarray, distance: float, corners: int, cap: str) -> np.ndarray:
    """The outlines (rows) around straight lines: ``_band`` of many, without repeated points."""
    d = b - a
    long = np.hypot(*d.T)[:, None]
    e = np.where(long > 0, d / np.where(long > 0, long, 1.0), np.array([1.0, 0.0]))
    n = np.column_stack([-e[:, 1], e[:, 0]])
    if cap == "square":
        a, b = a - e * distance, b + e * distance
    t = np.linspace(-np.pi / 2, np.pi / 2, 2 * corners + 1 if cap == "round" else 2)[None, :, None]
    around = distance * (np.cos(t) * e[:, None] + np.sin(t) * n[:, None])
    return np.concatenate([b[:, None] + around, a[:, None] - around], axis=1)


def buffer_line(line: Column, distance: float, corners: int = 8, cap: str = "round") -> Column:
    """The area within ``distance`` of a line, as closed rings (a bent line may enclose holes); ``cap`` is 'round', 'flat' or 'square'.

    A line of one vertex is a point: a disc, a square, or with flat caps nothing.
    Null and empty lines give null. Straight lines and points, whose outline is a
    single band, are drawn a batch at a time.
    """
    def batch(g: pa.Array) -> pa.Array:
        lines, given = Outlines(g, False), pc.fill_null(pc.list_value_length(g), 0).to_numpy()
        whole = (np.bincount(lines.part, minlength=len(g)) == given) & (given > 0) & (distance > 0)
        real = lines.long > 0
        owner = np.repeat(np.arange(len(g)), lines.count)
        runs = np.bincount(owner[real], minlength=len(g))
        slow = {int(k): _closed(buffered([_xy(g[k].as_py())], distance, corners, cap)) for k in np.flatnonzero((given > 0) & ~(whole & (runs < 2)))}
        rows = np.flatnonzero(whole & (runs < 2))
        a, b = lines.start[rows], lines.start[rows].copy()
        straight = runs[rows] == 1
        b[straight] = lines.seg[real & (runs == 1)[owner] & whole[owner], 2:]
        rings = _bands(a, b, distance, corners, cap)
        keep = np.ones(rings.shape[:2], dtype=bool)
        keep[~straight] = False if cap == "flat" else keep[~straight]
        if cap == "round":  # around a point the two caps share their ends
            half = rings.shape[1] // 2
            keep[~straight, half] = keep[~straight, -1] = False
        return _mixed(keep.sum(axis=1), rings[keep], rows, slow, len(g))

    def of(g: pa.Array) -> pa.Array:
        return batch(g)

    return F.arrow_udf(of, _parse_datatype_string(f"array<{LINE}>"))(line)


#: Corners up to which a convex ring is grown or shrunk by rule.
BY_RULE = 32


def _convex(xy: np.ndarray, distance: float, corners: int) -> np.ndarray:
    """Which counter-clockwise rings (rows) are convex and, to grow, so wide everywhere that a corner's arc sees its own two sides only."""
    n = xy.shape[1]
    d = np.roll(xy, -1, axis=1) - xy
    long = np.hypot(d[..., 0], d[..., 1])
    before = np.roll(d, 1, axis=1)
    turn = _turn(before, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        ok = (turn > 1e-9 * long * np.roll(long, 1, axis=1)).all(axis=1) & (np.abs(np.arctan2(turn, (before * d).sum(axis=-1)).sum(axis=1) - 2 * np.pi) < 1e-6)
        if distance > 0:
            least = distance * np.sin(np.pi / corners / 4) * (1 + 1e-6)
            away = _turn(d[:, None], xy[:, :, None] - xy[:, None]) / long[:, None]  # of corner i from the line of side j
            i, j = np.indices((n, n))
            ok &= (long >= least).all(axis=1) & ((away >= least) | (i == j) | (i == (j + 1) % n)).all(axis=(1, 2))
    return ok


def _grown(xy: np.ndarray, distance: float, corners: int) -> tuple[np.ndarray, np.ndarray]:
    """(points of each ring, points) of convex rings (rows) grown: at a corner the caps of both sides, and where they cross if their points differ."""
    step = np.pi / corners / 2
    d = np.roll(xy, -1, axis=1) - xy
    before = np.roll(d, 1, axis=1)
    theta = np.arctan2(_turn(before, d), (before * d).sum(axis=-1)).ravel()
    start = (np.arctan2(before[..., 1], before[..., 0]) - np.pi / 2).ravel()
    q = np.floor(theta / step + 1e-9)
    rest = theta - q * step
    same = np.abs(rest) < 1e-8
    count = np.where(same, q + 1, 4 * q + 3).astype(int)
    corner, k = expand(count)
    kind, turn, rest, same = k % 4, (k // 4) * step, rest[corner], same[corner]
    angle = np.where(same, k * step, turn + np.choose(kind, [0 * rest, rest / 2, rest, (rest + step) / 2]))
    apothem = np.cos(step / 2)
    far = np.where(same, 1.0, np.choose(kind, [1.0 + 0 * rest, apothem / np.cos((step - rest) / 2), 1.0 + 0 * rest, apothem / np.cos(rest / 2)]))
    angle = start[corner] + angle
    points = xy.reshape(-1, 2)[corner] + distance * far[:, None] * np.column_stack([np.cos(angle), np.sin(angle)])
    return count.reshape(xy.shape[:2]).sum(axis=1), points


def _shrunk(xy: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """(points of each ring, points) of convex rings (rows) cut by their own sides moved inwards; none where nothing is left."""
    low, size = xy.min(axis=1, keepdims=True), np.ptp(xy, axis=1).max(axis=1) if len(xy) else np.zeros(0)
    xy = xy - low
    d = np.roll(xy, -1, axis=1) - xy
    inward = np.stack([-d[..., 1], d[..., 0]], axis=-1) / np.hypot(d[..., 0], d[..., 1])[..., None] * distance
    out = xy
    for k in range(xy.shape[1]):
        a = xy[:, k] + inward[:, k]
        out = half_planes(out, a, a + d[:, k])
    apart = (np.abs(out - np.roll(out, 1, axis=1)) > 1e-9 * size[:, None, None]).any(axis=-1)
    keep = apart & (polygon_areas(out) > 1e-9 * size**2)[:, None]
    keep &= keep.sum(axis=1, keepdims=True) > 2
    return keep.sum(axis=1), (out + low)[keep]


def buffer_area(poly: Column, distance: float, corners: int = 8) -> Column:
    """An area grown by ``distance``, or with a negative one shrunk (perhaps to nothing), as closed rings.

    Convex areas without holes are done by rule, a batch at a time.
    """

    def grow(rings):
        area = region_of(rings)
        if not area or distance == 0:
            return _closed(area)
        edge = buffered([np.vstack([r, r[:1]]) for r in area], abs(distance), corners, area=area if distance > 0 else ())
        return _closed(edge if distance > 0 else combine([area, edge], RULES["difference"]))

    def batch(g: pa.Array) -> pa.Array:
        areas, rings = Outlines(g, True), pc.fill_null(pc.list_value_length(g), 0).to_numpy()
        given = pc.fill_null(pc.list_value_length(g.flatten()), 0).to_numpy()
        points = np.bincount(areas.part, minlength=len(given))
        first = np.cumsum(points) - points
        n = points.copy()
        some = np.flatnonzero(n > 1)
        n[some] -= (areas.xy[first[some]] == areas.xy[first[some] + points[some] - 1]).all(axis=1)
        alone = (rings[areas.shape_of] == 1) & (points == given) & (distance != 0)
        rows, sizes, out = [], [], []
        for size in np.unique(n[alone & (n > 2) & (n <= BY_RULE)]):
            ring = np.flatnonzero(alone & (n == size))
            xy = areas.xy[first[ring][:, None] + np.arange(size)]
            turned = polygon_areas(xy) < 0
            xy[turned] = xy[turned, ::-1]
            ok = _convex(xy, distance, corners)
            m, p = _grown(xy[ok], distance, corners) if distance > 0 else _shrunk(xy[ok], -distance)
            rows.append(areas.shape_of[ring[ok]])
            sizes.append(m)
            out.append(p)
        rows, sizes, xy = (np.concatenate([e, *x]) for e, x in ((np.zeros(0, dtype=int), rows), (np.zeros(0, dtype=int), sizes), (np.zeros((0, 2)), out)))
        left = g.is_valid().to_numpy(zero_copy_only=False).copy()
        left[rows] = False
        return _mixed(sizes, xy, rows, {int(k): grow(g[k].as_py()) for k in np.flatnonzero(left)}, len(g))

    def of(g: pa.Array) -> pa.Array:
        return batch(g)

    return F.arrow_udf(of, _parse_datatype_string(f"array<{LINE}>"))(poly)
