"""Spatial joins over grid cells: what meets, what is near, what lies within.

Each side is dealt out over the cells its box touches and joined on the cell; a
pair counts in the cell that owns the lower left corner of what both boxes
share, so it comes out once without another shuffle. Cells should be about as
wide as typical shapes plus the distance; crowded ones are counted beforehand and
dealt out over several tasks, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from wayloom.functions import cutting
from wayloom.functions import line as L
from wayloom.functions import polygon as P
from wayloom.functions import regions, shapes
from wayloom.functions.let import point
from wayloom.operators.staged import spread, staged
from wayloom.session import checkpointed


#: Rows of a side in a cell beyond which the cell is dealt out, and cells that may be; a cell that isn't among the most crowded has at most a 1 / HOT_CELLS share of the rows.
HOT_ROWS, HOT_CELLS = 5_000, 100_000
BOX = ("minx", "miny", "maxx", "maxy")


def cell_join(left: DataFrame, right: DataFrame, cell: Sequence[str] = ("cx", "cy"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` and ``right`` joined on their cell, crowded cells in hands.

    Both sides are counted by cell, map-side first. A side with n times
    ``hot_rows`` rows in a cell is dealt out over n hands by a hash of the row, and
    the other side goes to each hand: every pair meets once, in groups of about
    ``hot_rows`` on either side. The hot cells are broadcast, at most HOT_CELLS of
    them, the most crowded; that needs no step of its own while the plan is made.
    """
    a, b = dealt_cells(left, right, cell, hot_rows)
    return a.join(b, [*cell, "_lh_", "_rh_"]).drop("_lh_", "_rh_")


def dealt_cells(left: DataFrame, right: DataFrame, cell: Sequence[str] = ("cx", "cy"), hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with the hands ``_lh_, _rh_`` that their rows go to."""
    keys = list(cell)
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    hands = lambda n: F.ceil(F.col(n) / hot_rows).cast("int")
    hot = counts.where((F.greatest("l", "r") > hot_rows) & (F.least("l", "r") > 0)).orderBy(F.greatest("l", "r").desc()).limit(HOT_CELLS)
    hot = F.broadcast(hot.select(*keys, F.greatest(hands("l"), F.lit(1)).alias("_lh"), F.greatest(hands("r"), F.lit(1)).alias("_rh")))

    def dealt(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        marked = df.join(hot, keys, "left")
        own = F.when(F.col(mine) > 1, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col(mine)).cast("int")).otherwise(0)
        every = F.when(F.col(theirs) > 1, F.sequence(F.lit(0), F.col(theirs) - 1)).otherwise(F.array(F.lit(0)))
        return marked.withColumns({f"{mine}_": own, f"{theirs}_": F.explode(every)}).drop("_lh", "_rh")

    return dealt(left, "_lh", "_rh"), dealt(right, "_rh", "_lh")


def grid_join(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, cell: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` and ``right`` (as structs ``a`` and ``b``) of every pair whose boxes meet, each once.

    Boxes are (minx, miny, maxx, maxy); rows without one meet nothing.
    """
    pairs = cell_join(_in_cells(left, left_box, "a", cell), _in_cells(right, right_box, "b", cell), hot_rows=hot_rows)
    a, b = F.col("a_box"), F.col("b_box")
    meet = (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])
    own = (F.floor(F.greatest(a["minx"], b["minx"]) / cell) == F.col("cx")) & (F.floor(F.greatest(a["miny"], b["miny"]) / cell) == F.col("cy"))
    return pairs.where(meet & own).select("a", "b")


def _in_cells(df: DataFrame, box: Column, name: str, cell: float) -> DataFrame:
    """Rows (as a struct) with their box, one for each cell that it touches."""
    boxed = df.select(F.struct(*df.columns).alias(name), box.alias(f"{name}_box")).where(F.col(f"{name}_box.minx").isNotNull())
    b = F.col(f"{name}_box")
    steps = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return boxed.withColumn("cx", F.explode(steps(b["minx"], b["maxx"]))).withColumn("cy", F.explode(steps(b["miny"], b["maxy"])))


#: Rows of a side in a cell beyond which it is dealt out where shapes are cut in numpy: all pairs of a group come out of one call.
CUT_ROWS = 2_000


def cut_in_cells(left: DataFrame, right: DataFrame, left_box: Column, right_box: Column, cell: float, work: Callable, schema: str, hot_rows: int = CUT_ROWS) -> DataFrame:
    """``work(cx, cy, left, right, left boxes, right boxes)`` over the shapes (``id, geometry``, ...) of every cell that both sides touch.

    It gets Arrow tables, each shape once however many it may meet, and gives
    record batches of ``schema``. Cells are dealt out as in ``cell_join``.
    """
    def met(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([], schema=kinds)
        if a.num_rows == 0 or b.num_rows == 0:
            return empty
        boxes = [np.column_stack([t.column(f"_box_{k}").to_numpy() for k in BOX]).astype(float) for t in (a, b)]
        batches = list(work(key[0].as_py(), key[1].as_py(), a, b, *boxes))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(batch, kinds)], schema=kinds) for batch in batches], schema=kinds)

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    keys = ["cx", "cy", "_lh_", "_rh_"]
    sides = dealt_cells(_in_cells(left, left_box, "s", cell), _in_cells(right, right_box, "s", cell), hot_rows=hot_rows)
    flat = [spread(d.select(*keys, "s.*", *[F.col(f"s_box.{k}").cast("double").alias(f"_box_{k}") for k in BOX]), *keys) for d in sides]
    return flat[0].groupBy(*keys).cogroup(flat[1].groupBy(*keys)).applyInArrow(met, schema)


def box_of(points: Column, grow: float = 0.0) -> Column:
    """The box around an array of points, grown; null for none."""
    b = P.bounds(points)
    return F.struct((b["minx"] - grow).alias("minx"), (b["miny"] - grow).alias("miny"), (b["maxx"] + grow).alias("maxx"), (b["maxy"] + grow).alias("maxy"))


def _point_box(grow: float = 0.0) -> Column:
    return F.struct((F.col("x") - grow).alias("minx"), (F.col("y") - grow).alias("miny"), (F.col("x") + grow).alias("maxx"), (F.col("y") + grow).alias("maxy"))


def total_bounds(df: DataFrame, points: Column) -> DataFrame:
    """One row (minx, miny, maxx, maxy) around all geometries."""
    b = df.select(P.bounds(points).alias("b"))
    return b.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def intersecting_lines(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """``a_id, b_id, points`` of lines (``id, geometry``) that cross."""
    pairs = grid_join(a.select("id", "geometry"), b.select("id", "geometry"), box_of(F.col("geometry")), box_of(F.col("geometry")), cell)
    out = staged(pairs, {"points": L.line_crossings(F.col("a.geometry"), F.col("b.geometry"))}).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "points")
    return out.where(F.size("points") > 0)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """``point_id, polygon_id`` of points (``id, x, y``) in areas (``id, geometry``)."""
    pairs = grid_join(points.select("id", "x", "y"), polygons.select("id", "geometry"), _point_box(), box_of(F.get("geometry", F.lit(0))), cell)
    inside = P.contains(F.col("b.geometry"), point(F.col("a.x"), F.col("a.y")))
    return pairs.where(inside).select(F.col("a.id").alias("point_id"), F.col("b.id").alias("polygon_id"))


def count_points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float, count: str = "count") -> DataFrame:
    """``polygons`` with the number of points in each; null for none."""
    n = points_in_polygons(points, polygons, cell).groupBy(F.col("polygon_id").alias("id")).agg(F.count("*").alias(count))
    return polygons.join(n, "id", "left")


def within_polygon(df: DataFrame, polygon: DataFrame, p: Column) -> DataFrame:
    """Rows whose point lies in any area (``geometry``) of a frame: one area or a few, broadcast, each with its box first.

    Many areas belong into ``points_in_polygons``, which deals both sides out over cells.
    """
    area = F.broadcast(polygon.where("geometry is not null").select(F.col("geometry").alias("_area"), P.bounds(F.get("geometry", F.lit(0))).alias("_b")))
    boxed = p["x"].between(F.col("_b.minx"), F.col("_b.maxx")) & p["y"].between(F.col("_b.miny"), F.col("_b.maxy"))
    return df.join(area, boxed & P.contains(F.col("_area"), p), "left_semi")


def _meeting(shapes_: DataFrame, polygons: DataFrame, cell: float, rings: bool) -> DataFrame:
    """``shapes_`` that meet any area, each once: a shape that has met one isn't held against the rest of its group."""
    def work(cx: int, cy: int, left: pa.Table, right: pa.Table, left_box: np.ndarray, right_box: np.ndarray) -> Iterator[list]:
        a, b = cutting.Outlines(left.column("geometry"), rings), cutting.Outlines(right.column("geometry"), True)
        met = cutting.any_met(a, b, left_box, right_box, cutting.areas_meet if rings else cutting.lines_meet)
        yield [pc.unique(left.column("id").filter(pa.array(met)))]

    g = F.get("geometry", F.lit(0)) if rings else F.col("geometry")
    met = cut_in_cells(shapes_.select("id", "geometry"), polygons.select("geometry"), box_of(g), box_of(F.get("geometry", F.lit(0))), cell, work, f"id {_kind(shapes_)}")
    return shapes_.join(met.distinct(), "id", "left_semi")


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def lines_meeting_polygons(lines: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Lines (``id, geometry``) that lie in or cross any area (``id, geometry``), each once."""
    return _meeting(lines, polygons, cell, rings=False)


def areas_meeting_polygons(areas: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Areas (``id, geometry``) that share a point with any area of ``polygons``, each once: a boundary crosses the other's, or one lies in the other."""
    return _meeting(areas, polygons, cell, rings=True)


#: What is asked of the parts of lines, and the columns that it gives.
PART_COLUMNS = {"geometry": f"part int, geometry {shapes.LINE}", "length": "part int, length double", "total": "length double"}


def _line_parts(lines: DataFrame, polygons: DataFrame, cell: float, within: bool, give: str) -> DataFrame:
    def work(cx: int, cy: int, left: pa.Table, right: pa.Table, left_box: np.ndarray, right_box: np.ndarray) -> Iterator[list]:
        a, b = cutting.Outlines(left.column("geometry"), False), cutting.Outlines(right.column("geometry"), True)
        ids = [t.column("id").combine_chunks() for t in (left, right)]
        for i, j in cutting.box_pairs(left_box, right_box, cell, cx, cy):
            pair, lo, hi = cutting.pieces(a, b, i, j, within)
            if give == "total":
                n, long = np.bincount(pair, minlength=len(i)), np.bincount(pair, weights=hi - lo, minlength=len(i))
                yield [ids[0].take(pa.array(i[n > 0])), ids[1].take(pa.array(j[n > 0])), long[n > 0]]
                continue
            n = np.bincount(pair, minlength=len(i))
            part = cutting.expand(n)[1].astype(np.int32)
            yield [ids[0].take(pa.array(i[pair])), ids[1].take(pa.array(j[pair])), part, cutting.stretches(a, i[pair], lo, hi) if give == "geometry" else hi - lo]

    return cut_in_cells(lines.select("id", "geometry"), polygons.select("id", "geometry"), box_of(F.col("geometry")), box_of(F.get("geometry", F.lit(0))), cell, work, f"line_id {_kind(lines)}, polygon_id {_kind(polygons)}, {PART_COLUMNS[give]}")


def lines_in_polygons(lines: DataFrame, polygons: DataFrame, cell: float, give: str = "geometry") -> DataFrame:
    """``line_id, polygon_id, part, geometry`` of the parts of lines inside areas.

    ``give='length'`` has each part's length instead of its geometry, ``'total'`` only
    ``line_id, polygon_id, length`` of all parts of a pair; pairs without parts have no row.
    """
    return _line_parts(lines, polygons, cell, True, give)


def lines_outside_polygons(lines: DataFrame, polygons: DataFrame, cell: float, give: str = "geometry") -> DataFrame:
    """The parts of lines outside each area whose box they meet, one area at a time (not outside all of them); ``give`` as in ``lines_in_polygons``."""
    return _line_parts(lines, polygons, cell, False, give)


def overlay_areas(a: DataFrame, b: DataFrame, cell: float, hows: Sequence[str] = ("intersection",)) -> DataFrame:
    """``a_id, b_id`` and by each of ``hows`` (as in ``regions.overlay``) a column of closed rings, of every pair of areas whose boxes meet."""
    def work(cx: int, cy: int, left: pa.Table, right: pa.Table, left_box: np.ndarray, right_box: np.ndarray) -> Iterator[list]:
        x, y = (cutting.Outlines(t.column("geometry"), True) for t in (left, right))
        ids = [t.column("id").combine_chunks() for t in (left, right)]
        for i, j in cutting.box_pairs(left_box, right_box, cell, cx, cy):
            for at in cutting.blocks((x.count[i] + y.count[j]) ** 2):
                yield [ids[0].take(pa.array(i[at])), ids[1].take(pa.array(j[at])), *regions.overlays(x, y, i[at], j[at], hows)]

    box = box_of(F.get("geometry", F.lit(0)))
    made = ", ".join(f"{how} array<{shapes.LINE}>" for how in hows)
    return cut_in_cells(a.select("id", "geometry"), b.select("id", "geometry"), box, box, cell, work, f"a_id {_kind(a)}, b_id {_kind(b)}, {made}")


def nearest_line(points: DataFrame, lines: DataFrame, distance: float, cell: float | None = None) -> DataFrame:
    """``point_id, line_id, distance, place, x, y`` of the nearest line within a distance; of equal ones the lower id.
    Points without any have null."""
    near = grid_join(points.select("id", "x", "y"), lines.select("id", "geometry"), _point_box(distance), box_of(F.col("geometry")), cell or 2 * distance)
    n = staged(near.select("a", "b"), {"n": L.nearest(point(F.col("a.x"), F.col("a.y")), F.col("b.geometry"))}).where(F.col("n.distance") <= distance)
    n = n.select(F.col("a.id").alias("point_id"), F.col("b.id").alias("line_id"), "n")
    best = n.groupBy("point_id").agg(F.min(F.struct("n.distance", "line_id", "n.place", "n.x", "n.y")).alias("b")).select("point_id", "b.line_id", "b.distance", "b.place", "b.x", "b.y")
    return points.select(F.col("id").alias("point_id")).join(best, "point_id", "left")


def points_within(a: DataFrame, b: DataFrame, distance: float) -> DataFrame:
    """``a_id, b_id, distance`` of points (``id, x, y``) at most so far apart."""
    cx, cy = F.floor(F.col("x") / distance), F.floor(F.col("y") / distance)
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cx.alias("cx"), cy.alias("cy"))
    around = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(around).alias("c")).select("b_id", "bx", "by", "c.*")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return cell_join(left, right).select("a_id", "b_id", d.alias("distance")).where(F.col("distance") <= distance)


#: Waiting points up to which all of them are held against all of ``b`` in blocks.
FEW_WAITING = 2_000


def _nearest_in_blocks(waiting: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``b`` for a few points, held by every worker: each block of ``b`` gives its own best, which are merged."""
    at = waiting.toPandas()
    xy, ids = at[["x", "y"]].to_numpy(dtype=float), pa.array(at["id"], to_arrow_type(waiting.schema["id"].dataType))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            order = pc.sort_indices(batch.column("id")).to_numpy()  # so that of equal distances the lower id comes first
            for lo in range(0, len(xy), 200):
                q = xy[lo : lo + 200]
                far = np.sqrt((q[:, :1] - x[order]) ** 2 + (q[:, 1:] - y[order]) ** 2)
                best = np.argsort(far, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(lo, lo + len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), batch.column("id").take(pa.array(order[best.ravel()])), pa.array(np.take_along_axis(far, best, axis=1).ravel())], names=["a_id", "b_id", "distance"])

    kinds = [f.schema["id"].dataType.simpleString() for f in (waiting, b)]
    return b.select("id", F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(near, f"a_id {kinds[0]}, b_id {kinds[1]}, distance double")


def nearest_points(a: DataFrame, b: DataFrame, k: int, start: float, few: int = FEW_WAITING) -> DataFrame:
    """``a_id, b_id, distance, rank`` of the ``k`` nearest points of ``b``, of equal ones the lower id.

    The search begins within ``start`` and doubles for those that have found
    fewer than ``k``, so most points see one round. Once at most ``few`` wait,
    they are held against all of ``b`` in blocks, however far that is; so nobody
    is left out, and late rounds don't join widening circles. Where ``b`` has
    fewer than ``k`` points, all are given. Rows without id or coordinates neither
    search nor are found.
    """
    b = checkpointed(b.select("id", "x", "y").where("id is not null and x is not null and y is not null"))
    k = min(k, b.count())
    waiting = a.select("id", "x", "y").where("id is not null and x is not null and y is not null").dropDuplicates(["id"])
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))).where(F.col("rank") <= k)
    kinds = [f.schema["id"].dataType.simpleString() for f in (a, b)]
    out = a.sparkSession.createDataFrame([], f"a_id {kinds[0]}, b_id {kinds[1]}, distance double, rank int")
    if k == 0:
        return out
    waiting, radius = checkpointed(waiting), start
    while (left := waiting.count()) > 0:
        if left <= few:
            return out.unionByName(ranked(_nearest_in_blocks(waiting, b, k)))
        found = ranked(points_within(waiting, b, radius))
        full = checkpointed(found.withColumn("_n", F.count("*").over(Window.partitionBy("a_id"))).where(F.col("_n") == k).drop("_n"))
        out = out.unionByName(full)
        waiting = checkpointed(waiting.join(full.select(F.col("a_id").alias("id")).distinct(), "id", "left_anti"))
        radius *= 2
    return out


def attach_nearest_attributes(nodes: DataFrame, points: DataFrame, distance: float, columns: Sequence[str]) -> DataFrame:
    """Nodes (``node, x, y, ...``) with columns of the nearest point (``id, x, y, ...``) within a distance; a node's own values win."""
    near = points_within(nodes.select(F.col("node").alias("id"), "x", "y"), points, distance)
    best = near.groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("b")).select(F.col("a_id").alias("node"), F.col("b.b_id").alias("_pid"))
    own = points.select(F.col("id").alias("_pid"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = nodes.join(best, "node", "left").join(own, "_pid", "left")
    return joined.withColumns({c: F.coalesce(c, f"_p_{c}") if c in nodes.columns else F.col(f"_p_{c}") for c in columns}).drop("_pid", *[f"_p_{c}" for c in columns])


def area_weighted(source: DataFrame, target: DataFrame, cell: float, extensive: Sequence[str] = (), intensive: Sequence[str] = (), prefix: str = "", suffix: str = "", rectangles: bool = False) -> DataFrame:
    """``target`` (``id, geometry``) with sums of extensive columns dealt out by share of the source's area, and means
    of intensive ones weighted by shared area. Targets that share no area have null. ``rectangles`` takes
    every shape for its box and stays in the JVM."""
    if rectangles:
        pairs = grid_join(target.select("id", "geometry"), source.select("id", "geometry", *extensive, *intensive), box_of(F.get("geometry", F.lit(0))), box_of(F.get("geometry", F.lit(0))), cell)
        a, b = P.bounds(F.get(F.col("a.geometry"), F.lit(0))), P.bounds(F.get(F.col("b.geometry"), F.lit(0)))
        side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        cut = pairs.select(F.col("a.id").alias("id"), (side("minx", "maxx") * side("miny", "maxy")).alias("w"), P.area(F.col("b.geometry")).alias("s"), *[F.col(f"b.{c}").alias(c) for c in [*extensive, *intensive]]).where("w > 0")
        sums = [F.sum(F.when(F.col("s") > 0, F.col(c) * F.col("w") / F.col("s"))).alias(prefix + c + suffix) for c in extensive]
        means = [(F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(prefix + c + suffix) for c in intensive]
    else:
        cut = _shared_sums(source, target, cell, extensive, intensive)
        sums = [F.sum(f"_e{k}").alias(prefix + c + suffix) for k, c in enumerate(extensive)]
        means = [(F.sum(f"_i{k}") / F.sum(f"_w{k}")).alias(prefix + c + suffix) for k, c in enumerate(intensive)]
    return target.join(cut.groupBy("id").agg(*sums, *means), "id", "left")


def _shared_sums(source: DataFrame, target: DataFrame, cell: float, extensive: Sequence[str], intensive: Sequence[str]) -> DataFrame:
    """``id`` of targets with sums over the sources that they meet in a cell: ``_e`` of shares, ``_i`` of values times shared area, ``_w`` of that area."""
    def work(cx: int, cy: int, left: pa.Table, right: pa.Table, left_box: np.ndarray, right_box: np.ndarray) -> Iterator[list]:
        a, b = (cutting.Parts(cutting.Outlines(t.column("geometry"), True)) for t in (left, right))
        values = [right.column(c).to_numpy() for c in right.column_names if c.startswith("_v")]
        there = [pc.is_valid(right.column(c)).to_numpy() for c in right.column_names if c.startswith("_v")]
        ids = left.column("id").combine_chunks()
        for i, j in cutting.box_pairs(left_box, right_box, cell, cx, cy):
            w = cutting.shared_areas(a, b, i, j)
            i, j, w = i[w > 0], j[w > 0], w[w > 0]
            some = np.unique(i)
            out = []

            def sums(x: np.ndarray, ok: np.ndarray) -> pa.Array:
                n = np.bincount(i[ok], minlength=left.num_rows)[some]  # noqa: B023
                return pa.array(np.bincount(i[ok], weights=x[ok], minlength=left.num_rows)[some], mask=n == 0)  # noqa: B023

            for k, (v, ok) in enumerate(zip(values, there)):
                if k < len(extensive):
                    out.append(sums(v[j] * w / np.where(b.area[j] > 0, b.area[j], 1.0), ok[j] & (b.area[j] > 0)))
                else:
                    out += [sums(v[j] * w, ok[j]), sums(w, ok[j])]
            yield [ids.take(pa.array(some)), *out]

    s = source.select("geometry", *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate([*extensive, *intensive])])
    made = [*[f"_e{k} double" for k in range(len(extensive))], *[f"_i{k} double, _w{k} double" for k in range(len(intensive))]]
    return cut_in_cells(target.select("id", "geometry"), s, box_of(F.get("geometry", F.lit(0))), box_of(F.get("geometry", F.lit(0))), cell, work, ", ".join([f"id {_kind(target)}", *made]))


def nearest_feature(shapes_left: DataFrame, lines: DataFrame, distance: float, hausdorff: bool = False) -> DataFrame:
    """``left_id, line_id, distance`` of the nearest line to each line, by least distance between them or by the
    lesser of the directed Hausdorff distances, among those whose boxes lie within ``distance``."""
    pairs = grid_join(shapes_left.select("id", "geometry"), lines.select("id", "geometry"), box_of(F.col("geometry"), distance), box_of(F.col("geometry")), 4 * distance)
    g, h = F.col("a.geometry"), F.col("b.geometry")
    if hausdorff:
        d = F.least(L.directed_hausdorff(g, h), L.directed_hausdorff(h, g))
    else:
        ends = F.least(F.array_min(F.transform(g, lambda p: L.distance_to_line(p, h))), F.array_min(F.transform(h, lambda p: L.distance_to_line(p, g))))
        d = F.when(F.size(L.line_crossings(g, h)) > 0, 0.0).otherwise(ends)
    best = pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("line_id"), d.alias("distance")).groupBy("left_id").agg(F.min(F.struct("distance", "line_id")).alias("b"))
    return best.select("left_id", "b.line_id", "b.distance")
