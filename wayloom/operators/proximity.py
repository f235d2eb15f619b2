"""Lines near areas: a quadtree learned from a sample, R-trees per leaf, exact refinement.

1. A bounded sample of first vertices on both sides shapes a quadtree whose
   leaves hold about ``leaf_rows`` features each; a leaf that can't be split
   further (everything in one spot) is salted on both sides instead.
2. Every feature goes to each leaf its box meets (lines grown by the distance):
   boundary replication, so no pair is lost.
3. A leaf's areas are bulk-loaded into a packed R-tree, probed with the leaf's
   lines; survivors are measured exactly.
4. A pair counts only in the leaf that owns its reference point, the lower left
   corner of what both boxes share, so each pair comes out once without a
   further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measured pairs of segments at a time, so that a worker's memory is bounded.
CHUNK = 400_000
#: A hair of tolerance for coordinates given in decimals.
EPSILON = 1e-9
#: Bounds of the sample that shapes the quadtree.
LEAST_SAMPLE, MOST_SAMPLE = 40_000, 2_000_000


# --- the quadtree ---------------------------------------------------------


@dataclass
class QuadTree:
    """Nodes in arrays; ``child`` is the first of four children or -1, ``leaf`` a leaf's number or -1."""

    box: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    salts: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, capacity: float, smallest: float, deepest: int = 24) -> QuadTree:
        """From sampled points; a leaf has at most ``capacity`` of them, unless its side is down to ``smallest``."""
        if len(points) == 0:
            points = np.zeros((1, 2))
        low, high = points.min(axis=0), points.max(axis=0)
        side = max(float((high - low).max()), 1.0)
        box, child, leaf, salts = [[low[0], low[1], low[0] + side, low[1] + side]], [-1], [-1], []
        todo = [(0, np.arange(len(points)), 0)]
        while todo:
            node, own, depth = todo.pop()
            x0, y0, x1, y1 = box[node]
            if len(own) <= capacity or depth >= deepest or (x1 - x0) / 2 < smallest:
                leaf[node] = len(salts)
                salts.append(max(1, int(np.ceil(len(own) / max(1.0, 2 * capacity)))))
                continue
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            child[node] = len(box)
            quarter = (points[own, 0] >= mx).astype(int) + 2 * (points[own, 1] >= my)
            for k in range(4):
                todo.append((len(box), own[quarter == k], depth + 1))
                box.append([mx if k & 1 else x0, my if k & 2 else y0, x1 if k & 1 else mx, y1 if k & 2 else my])
                child.append(-1)
                leaf.append(-1)
        return cls(np.array(box), np.array(child), np.array(leaf), np.array(salts))

    def clamp(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = self.box[0]
        return np.clip(x, x0, np.nextafter(x1, x0)), np.clip(y, y0, np.nextafter(y1, y0))

    def locate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each point; points outside belong to the nearest leaf at the rim."""
        x, y = self.clamp(x, y)
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.child[node] >= 0
            if not inner.any():
                return self.leaf[node]
            b = self.box[node[inner]]
            right = x[inner] >= (b[:, 0] + b[:, 2]) / 2
            upper = y[inner] >= (b[:, 1] + b[:, 3]) / 2
            node[inner] = self.child[node[inner]] + right + 2 * upper

    def cover(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row's box meets."""
        x0, y0 = self.clamp(box[:, 0], box[:, 1])
        x1, y1 = self.clamp(box[:, 2], box[:, 3])
        row, node = np.arange(len(box)), np.zeros(len(box), dtype=np.int64)
        rows, leaves = [], []
        while len(row):
            at_leaf = self.child[node] < 0
            rows.append(row[at_leaf])
            leaves.append(self.leaf[node[at_leaf]])
            row, node = row[~at_leaf], node[~at_leaf]
            row = np.repeat(row, 4)
            node = (self.child[node][:, None] + np.arange(4)).ravel()
            b = self.box[node]
            meets = (x0[row] < b[:, 2]) & (x1[row] >= b[:, 0]) & (y0[row] < b[:, 3]) & (y1[row] >= b[:, 1])
            row, node = row[meets], node[meets]
        return np.concatenate(rows), np.concatenate(leaves)


# --- the R-tree -----------------------------------------------------------


class PackedRTree:
    """Sort-tile-recursive bulk loading; all probes of a batch descend together."""

    FAN = 16

    def __init__(self, box: np.ndarray) -> None:
        self.count = len(box)
        order = self._tile(box)
        self.order = order
        self.levels = [box[order]]
        while len(self.levels[-1]) > self.FAN:
            below = self.levels[-1]
            starts = np.arange(0, len(below), self.FAN)
            self.levels.append(
                np.column_stack(
                    [
                        np.minimum.reduceat(below[:, 0], starts),
                        np.minimum.reduceat(below[:, 1], starts),
                        np.maximum.reduceat(below[:, 2], starts),
                        np.maximum.reduceat(below[:, 3], starts),
                    ]
                )
            )

    def _tile(self, box: np.ndarray) -> np.ndarray:
        n = len(box)
        cx, cy = box[:, 0] + box[:, 2], box[:, 1] + box[:, 3]
        slabs = max(1, int(np.ceil(np.sqrt(n / self.FAN))))
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(cx, kind="stable")] = np.arange(n)
        return np.lexsort((cy, rank // max(1, int(np.ceil(n / slabs)))))

    def probe(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) for all boxes that meet."""
        top = self.levels[-1]
        q = np.repeat(np.arange(len(query)), len(top))
        node = np.tile(np.arange(len(top)), len(query))
        for depth in range(len(self.levels) - 1, -1, -1):
            b, a = self.levels[depth][node], query[q]
            meets = (a[:, 0] <= b[:, 2]) & (a[:, 2] >= b[:, 0]) & (a[:, 1] <= b[:, 3]) & (a[:, 3] >= b[:, 1])
            q, node = q[meets], node[meets]
            if depth:
                size = len(self.levels[depth - 1])
                first = node * self.FAN
                n = np.minimum(self.FAN, size - first)
                q = np.repeat(q, n)
                node = np.repeat(first, n) + _ramp(n)
        return q, self.order[node]


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ... in one array."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


# --- exact measures -------------------------------------------------------


def _point_segment2(px, py, ax, ay, bx, by) -> np.ndarray:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def segment_distance2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of segments ``a[i]`` and ``b[i]`` (x0, y0, x1, y1); 0 where they cross."""
    ax, ay, bx, by = a.T
    cx, cy, dx, dy = b.T
    best = np.minimum(
        np.minimum(_point_segment2(ax, ay, cx, cy, dx, dy), _point_segment2(bx, by, cx, cy, dx, dy)),
        np.minimum(_point_segment2(cx, cy, ax, ay, bx, by), _point_segment2(dx, dy, ax, ay, bx, by)),
    )

    def turn(ox, oy, px, py, qx, qy):
        return (px - ox) * (qy - oy) - (py - oy) * (qx - ox)

    cross = (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (
        turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0
    )
    return np.where(cross, 0.0, best)


@dataclass
class Shapes:
    """Segments of many lines or rings; ``start``/``size`` give each shape's own."""

    segment: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @property
    def box(self) -> np.ndarray:
        s = self.segment
        low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
        return np.column_stack([np.minimum.reduceat(low, self.start), np.maximum.reduceat(high, self.start)])

    @classmethod
    def of(cls, xy: np.ndarray, sizes: np.ndarray, owner_sizes: np.ndarray | None = None) -> Shapes:
        """From vertices. ``sizes``: vertices of each part. Without ``owner_sizes`` parts are
        open lines, one a shape; with it they are rings, so many to a shape, and are closed."""
        end = np.cumsum(sizes)
        start = end - sizes
        if owner_sizes is None:
            keep = np.ones(len(xy), dtype=bool)
            keep[end - 1] = sizes == 1  # the last vertex starts no segment, but a lone point is one
            at = np.flatnonzero(keep)
            nxt = np.minimum(at + 1, np.repeat(end - 1, np.maximum(sizes - 1, 1)))
            n = np.maximum(sizes - 1, 1)
        else:
            at = np.arange(len(xy))
            nxt = at + 1
            nxt[end - 1] = start
            n = np.add.reduceat(sizes, np.cumsum(owner_sizes) - owner_sizes)
        return cls(np.column_stack([xy[at], xy[nxt]]), np.cumsum(n) - n, n)


def near_pairs(lines: Shapes, areas: Shapes, i: np.ndarray, j: np.ndarray, distance: float) -> np.ndarray:
    """How far line ``i[k]`` is from area ``j[k]``, exactly, for every k; infinite beyond ``distance``."""
    best = np.full(len(i), np.inf)
    line_box, area_box = lines.box, areas.box
    limit = (distance + EPSILON) ** 2
    for lo, hi in _chunks(lines.size[i] * np.minimum(areas.size[j], 64)):
        k = np.arange(lo, hi)
        n = lines.size[i[k]]
        pair = np.repeat(k, n)
        s = np.repeat(lines.start[i[k]], n) + _ramp(n)
        seg, box = lines.segment[s], area_box[j[pair]]
        keep = (
            (np.minimum(seg[:, 0], seg[:, 2]) <= box[:, 2] + distance) & (np.maximum(seg[:, 0], seg[:, 2]) >= box[:, 0] - distance)
            & (np.minimum(seg[:, 1], seg[:, 3]) <= box[:, 3] + distance) & (np.maximum(seg[:, 1], seg[:, 3]) >= box[:, 1] - distance)
        )
        pair, s = pair[keep], s[keep]
        for a, b in _chunks(areas.size[j[pair]]):
            p, own = pair[a:b], s[a:b]
            n = areas.size[j[p]]
            e = np.repeat(areas.start[j[p]], n) + _ramp(n)
            own, p = np.repeat(own, n), np.repeat(p, n)
            u, v = lines.segment[own], areas.segment[e]
            close = (
                (np.minimum(u[:, 0], u[:, 2]) - np.maximum(v[:, 0], v[:, 2]) <= distance) & (np.minimum(v[:, 0], v[:, 2]) - np.maximum(u[:, 0], u[:, 2]) <= distance)
                & (np.minimum(u[:, 1], u[:, 3]) - np.maximum(v[:, 1], v[:, 3]) <= distance) & (np.minimum(v[:, 1], v[:, 3]) - np.maximum(u[:, 1], u[:, 3]) <= distance)
            )
            u, v, p = u[close], v[close], p[close]
            far = segment_distance2(u, v)
            near = far <= limit
            np.minimum.at(best, p[near], far[near])
    # what crosses no boundary lies wholly inside or wholly outside: one vertex tells
    x, y = lines.segment[lines.start[i], 0], lines.segment[lines.start[i], 1]
    box = area_box[j]
    rest = np.flatnonzero((best > 0) & (x >= box[:, 0]) & (x <= box[:, 2]) & (y >= box[:, 1]) & (y <= box[:, 3]))
    for a, b in _chunks(areas.size[j[rest]]):
        k = rest[a:b]
        n = areas.size[j[k]]
        v = areas.segment[np.repeat(areas.start[j[k]], n) + _ramp(n)]
        px, py = np.repeat(x[k], n), np.repeat(y[k], n)
        spans = (v[:, 1] > py) != (v[:, 3] > py)
        rise = np.where(spans, v[:, 3] - v[:, 1], 1.0)
        right = spans & (px < (v[:, 2] - v[:, 0]) * (py - v[:, 1]) / rise + v[:, 0])
        if len(n):
            best[k[np.add.reduceat(right.astype(np.int64), np.cumsum(n) - n) % 2 == 1]] = 0.0
    return np.sqrt(best)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about CHUNK."""
    if len(sizes) == 0:
        return
    end = np.cumsum(sizes)
    cut = np.unique(np.concatenate([[0], np.searchsorted(end, np.arange(CHUNK, end[-1], CHUNK)) + 1, [len(sizes)]]))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist())


# --- rows in and out ------------------------------------------------------


def _vertices(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a flat array of points and which of them are whole."""
    x = points.field("x").to_numpy(zero_copy_only=False).astype(float)
    y = points.field("y").to_numpy(zero_copy_only=False).astype(float)
    good = np.isfinite(x) & np.isfinite(y)
    if points.null_count:
        good &= points.is_valid().to_numpy(zero_copy_only=False)
    return np.column_stack([x, y]), good


def _lists(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a list array, and how many each row has (a null row none)."""
    import pyarrow.compute as pc

    return array.flatten(), pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_good(good: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(good)])
    end = np.cumsum(sizes)
    return running[end] - running[end - sizes]


def _as_list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def assigner(tree_of, grow: float, rings: bool, first: bool):
    """Batches of (key, geometry, more...) to (leaf, salt, key, xy, sizes, more...).

    One row for each leaf that the box, grown by ``grow``, meets. In a leaf with
    n salts, both sides are dealt out over n hands by key, and each row meets
    all n hands of the other side: n * n groups of bounded size, and every pair
    in just one of them. ``first`` tells the two sides apart.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_of()
        for batch in batches:
            geometry = batch.column(1)
            if rings:
                ring_array, n_rings = _lists(geometry)
                points, n_points = _lists(ring_array)
            else:
                points, n_points = _lists(geometry)
                n_rings = np.ones(len(geometry), dtype=np.int64)
            xy, good = _vertices(points)
            n_points = _count_good(good, n_points)
            xy = xy[good]
            full = n_points > 0
            n_rings = _count_good(full, n_rings)
            n_points = n_points[full]
            rows = np.flatnonzero(n_rings > 0)
            if len(rows) == 0:
                continue
            n_rings = n_rings[rows]
            first_ring = np.cumsum(n_rings) - n_rings
            vertices = np.add.reduceat(n_points, first_ring)
            start = np.cumsum(vertices) - vertices
            box = np.column_stack([np.minimum.reduceat(xy, start), np.maximum.reduceat(xy, start)])
            box += np.array([-grow, -grow, grow, grow])
            row, leaf = tree.cover(box)
            n = tree.salts[leaf]
            hand = np.zeros(len(row), dtype=np.int64)
            if (n > 1).any():
                hand = (_mix(batch.column(0).take(pa.array(rows[row]))) % n.astype(np.uint64)).astype(np.int64)
            other = _ramp(n)
            row, leaf, hand, n = np.repeat(row, n), np.repeat(leaf, n), np.repeat(hand, n), np.repeat(n, n)
            salt = hand * n + other if first else other * n + hand
            n = vertices[row]
            picked = np.repeat(start[row], n) + _ramp(n)
            r = n_rings[row]
            picked_rings = n_points[np.repeat(first_ring[row], r) + _ramp(r)]
            taken = pa.array(rows[row])
            carried = [0, *range(2, batch.num_columns)]
            columns = {"leaf": pa.array(leaf, pa.int32()), "salt": pa.array(salt, pa.int32())}
            columns |= {batch.schema.names[c]: batch.column(c).take(taken) for c in carried[:1]}
            columns |= {"xy": _as_list(xy[picked].ravel(), 2 * n, pa.float64()), "sizes": _as_list(picked_rings, r, pa.int32())}
            columns |= {batch.schema.names[c]: batch.column(c).take(taken) for c in carried[1:]}
            yield pa.RecordBatch.from_pydict(columns)

    return assign


def _mix(keys: pa.Array) -> np.ndarray:
    """A hash of integer or text keys that doesn't change between runs."""
    if pa.types.is_integer(keys.type):
        h = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    else:
        import zlib

        h = np.array([zlib.crc32(str(k).encode()) for k in keys.to_pylist()], dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _shapes(table: pa.Table, rings: bool) -> tuple[pa.Array, Shapes]:
    """The shapes of a leaf, each key once."""
    seen = {k: n for n, k in reversed(list(enumerate(table.column("key").to_pylist())))}
    table = table.take(pa.array(sorted(seen.values()))).combine_chunks()
    xy = table.column("xy").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    sizes, per_row = _lists(table.column("sizes").combine_chunks())
    sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    return table.column("key").combine_chunks(), Shapes.of(xy, sizes, per_row if rings else None)


def _matcher(tree_of, distance: float, schema: pa.Schema):
    def match(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        leaf, tree = key[0].as_py(), tree_of()
        line_keys, lines = _shapes(left, rings=False)
        area_keys, areas = _shapes(right, rings=True)
        area_box = areas.box
        index, grown = PackedRTree(area_box), lines.box + np.array([-distance, -distance, distance, distance])
        out_i, out_j, out_d = [], [], []
        for lo in range(0, len(grown), 4096):
            i, j = index.probe(grown[lo : lo + 4096])
            i = i + lo
            mine = tree.locate(np.maximum(grown[i, 0], area_box[j, 0]), np.maximum(grown[i, 1], area_box[j, 1])) == leaf
            i, j = i[mine], j[mine]
            far = near_pairs(lines, areas, i, j, distance)
            near = np.isfinite(far)
            out_i.append(i[near])
            out_j.append(j[near])
            out_d.append(far[near])
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        columns = [line_keys.take(pa.array(i)), area_keys.take(pa.array(j)), pa.array(np.concatenate(out_d))]
        return pa.Table.from_arrays(columns[: len(schema)], schema=schema)

    return match


def learn_quadtree(sides, total: int, leaf_rows: int, smallest: float, sample_rows: int | None = None, seed: int = 7):
    """A function giving the broadcast quadtree, learned from a sample of ``sides``: (frame with ``key``, point column).

    ``total`` is the number of rows on all sides. The driver sees about
    ``sample_rows`` points, by default four a leaf but between LEAST_SAMPLE and
    MOST_SAMPLE, and the tree has no more leaves than that, whatever the size of
    the tables.
    """
    if sample_rows is None:
        sample_rows = min(MOST_SAMPLE, max(LEAST_SAMPLE, 4 * total // leaf_rows))
    share = min(1.0, sample_rows / max(1, total))
    # by a hash of the records, so that neither files nor partitions make a difference to the tree
    chosen = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    parts = [df.select("key", point.alias("p")).where(chosen if share < 1 else F.lit(True)).select(F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y")).toArrow() for df, point in sides]
    points = np.concatenate([np.column_stack([t.column(n).to_numpy().astype(float) for n in ("x", "y")]).reshape(-1, 2) for t in parts])
    points = points[np.isfinite(points).all(axis=1)]
    points = points[np.lexsort(points.T)]
    tree = QuadTree.build(points, max(1.0, leaf_rows * share), smallest)
    shared = sides[0][0].sparkSession.sparkContext.broadcast(tree)
    return lambda: shared.value


def lines_near_areas(
    lines: DataFrame,
    areas: DataFrame,
    distance: float,
    line_key: str,
    area_key: str,
    line_geometry: str = "geometry",
    area_geometry: str = "geometry",
    sample_rows: int | None = None,
    leaf_rows: int = 20_000,
    seed: int = 7,
    measure: str | None = None,
) -> DataFrame:
    """``line_key, area_key`` (and on demand their distance, in a column named ``measure``) of every line and area at most ``distance`` apart, each pair once.

    Lines are ``array<struct<x,y>>``, areas arrays of rings (the first is the
    shell, others are holes; open or closed, either direction). The distance
    from a line to an area it crosses or lies in is 0; holes are not area.
    Rows that repeat a key count once. Null or empty geometries give no pair,
    null or non-finite vertices are left out, a line of one vertex is a point.
    ``sample_rows`` bounds what the driver sees: the first vertices that shape
    the quadtree; results don't depend on it. Extra columns are not carried. The
    two key columns must have different names.
    """
    if line_key == area_key:
        raise ValueError("the two keys need different names")
    left = lines.select(F.col(line_key).alias("key"), F.col(line_geometry).alias("g")).where(F.col("g").isNotNull() & F.col("key").isNotNull())
    right = areas.select(F.col(area_key).alias("key"), F.col(area_geometry).alias("g")).where(F.col("g").isNotNull() & F.col("key").isNotNull())
    tree_of = learn_quadtree(
        [(left, F.get("g", F.lit(0))), (right, F.get(F.get("g", F.lit(0)), F.lit(0)))],
        lines.count() + areas.count(), leaf_rows, 4 * distance, sample_rows, seed,
    )
    kinds = {"key": left.schema["key"].dataType.simpleString(), "other": right.schema["key"].dataType.simpleString()}
    rows = "leaf int, salt int, key {}, xy array<double>, sizes array<int>"
    a = left.mapInArrow(assigner(tree_of, distance, rings=False, first=True), rows.format(kinds["key"]))
    b = right.mapInArrow(assigner(tree_of, 0.0, rings=True, first=False), rows.format(kinds["other"]))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = to_arrow_schema(
        StructType([StructField(line_key, left.schema["key"].dataType), StructField(area_key, right.schema["key"].dataType), *([StructField(measure, DoubleType())] if measure else [])])
    )
    return (
        a.groupBy("leaf", "salt")
        .cogroup(b.groupBy("leaf", "salt"))
        .applyInArrow(_matcher(tree_of, distance, schema), f"`{line_key}` {kinds['key']}, `{area_key}` {kinds['other']}" + (f", `{measure}` double" if measure else ""))
    )
