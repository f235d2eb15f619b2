"""Line conflation: which features of another source draw the same streets.

Candidates come from a grid join of boxes. Midpoint matching is Column
expressions throughout; Hausdorff matching measures and cuts candidate pairs in
Arrow batches, and shares a match feature out among its targets one at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import line as L
from wayloom.functions import shapes
from wayloom.functions.lists import merge_intervals
from wayloom.functions.names import name_score, standardize_streetname
from wayloom.functions.scalar import azimuth, azimuth_difference
from wayloom.operators.spatial import box_of, grid_join
from wayloom.operators.staged import spread, staged
from wayloom.session import checkpointed


def _lines(df: DataFrame) -> DataFrame:
    """Rows with an id and a line that has length."""
    return staged(df.where(F.col("id").isNotNull() & (F.size("geometry") > 1)), {"_len": L.length(F.col("geometry"))}).where("_len > 0")


def _attach_fields(out: DataFrame, matches: DataFrame, fields: Sequence[str] | bool, suffix: str) -> DataFrame:
    """Columns of the match feature, those of the same name suffixed; of repeated rows of one feature, the least values."""
    names = [c for c in matches.columns if c not in ("id", "geometry")] if fields is True else list(fields or [])
    if not names:
        return out
    one = F.struct(*[F.col(n).alias(n + suffix if n in out.columns else n) for n in names])
    own = matches.where("id is not null").groupBy(F.col("id").alias("match_id")).agg(F.min(one).alias("_own")).select("match_id", "_own.*")
    # stretches without a match need no partner, and their null keys would meet in one task
    found = out.where("match_id is not null").join(own, "match_id", "left")
    return found.unionByName(out.where("match_id is null"), allowMissingColumns=True)


def match_by_midpoint(
    targets: DataFrame,
    matches: DataFrame,
    distance: float,
    azimuth_tolerance: float | None = None,
    length_tolerance: float | None = None,
    incidence_tolerance: float | None = None,
    by_score: bool = False,
    stats: bool = False,
    vectors: bool = False,
    fields: Sequence[str] | bool = (),
    suffix: str = "_match",
    cell: float | None = None,
) -> DataFrame:
    """``targets`` (``id, geometry, ...``) with ``match_id`` and measures of the best match.

    Candidates lie within ``distance`` of the target's midpoint. The best is the
    nearest, or with ``by_score`` the one whose measures use up least of their
    tolerances on average, among those that meet all tolerances; ties go to the
    lower id. Measures: ``match_dist``, ``match_length`` (candidate less target),
    ``match_azimuth`` (0..90, at the nearest points), ``match_incidence`` (0..90,
    how far the connection is from a right angle). With ``stats`` a target whose
    candidates miss a tolerance keeps the measures of the best one without a
    ``match_id``, and tolerances hold up to and including their value; without,
    only below it. Null and empty geometries match nothing; targets keep all rows.
    """
    t = staged(_lines(targets.select("id", "geometry").dropDuplicates(["id"])), {"_mid": L.midpoint(F.col("geometry"))})
    m = _lines(matches.select("id", "geometry").dropDuplicates(["id"]))
    mid = F.array("_mid")
    pairs = grid_join(t, m, box_of(mid, distance), box_of(F.col("geometry")), cell or 4 * distance)
    g, h = F.col("a.geometry"), F.col("b.geometry")
    c = pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("match_id"), F.col("a._mid").alias("_mid"), g.alias("_g"), h.alias("_h"), F.col("a._len").alias("_lt"), F.col("b._len").alias("_lm"))
    c = staged(spread(c, "id", "match_id"), {"_n": L.nearest(F.col("_mid"), F.col("_h"))}).where(F.col("_n.distance") <= distance)
    along = L.azimuth_at(F.col("_g"), F.col("_lt") / 2)
    c = staged(c, {
        "match_dist": F.col("_n.distance"),
        "match_length": F.col("_lm") - F.col("_lt"),
        "match_azimuth": azimuth_difference(L.azimuth_at(F.col("_h"), F.col("_n.place")), along, directional=False),
        "match_incidence": 90 - azimuth_difference(azimuth(F.col("_mid.x"), F.col("_mid.y"), F.col("_n.x"), F.col("_n.y")), along, directional=False),
    })
    criteria = [("match_dist", distance), ("match_length", length_tolerance), ("match_azimuth", azimuth_tolerance), ("match_incidence", incidence_tolerance)]
    criteria = [(n, tol) for n, tol in criteria if tol]
    meets = F.lit(True)
    for n, tol in criteria:
        meets = meets & ((F.abs(n) <= tol) if stats or n == "match_dist" else (F.abs(n) < tol))
    if by_score:
        score = sum(((tol - F.least(F.abs(n), F.lit(tol))) / tol / len(criteria) for n, tol in criteria), F.lit(0.0))
    else:
        score = (distance - F.col("match_dist")) / distance
    c = c.withColumns({"_meets": meets, "match_score": score})
    if not stats:
        c = c.where("_meets")
    best = c.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("_meets").desc(), F.col("match_score").desc(), "match_id"))).where("_r = 1")
    columns = [F.when(F.col("_meets"), F.col("match_id")).alias("match_id"), "match_dist"]
    columns += [n for n, tol in (("match_length", length_tolerance), ("match_azimuth", azimuth_tolerance), ("match_incidence", incidence_tolerance)) if tol or stats]
    columns += ["match_score"] if by_score else []
    columns += [F.array("_mid", F.struct(F.col("_n.x").alias("x"), F.col("_n.y").alias("y"))).alias("match_vector")] if vectors else []
    out = targets.join(best.select("id", *columns), "id", "left")
    return _attach_fields(out, matches, fields, suffix)


def hausdorff_pairs(targets: DataFrame, matches: DataFrame, distance: float, azimuth_tolerance: float | None = None, length_tolerance: float = 0.0, cell: float | None = None) -> DataFrame:
    """``target_id, match_id, match_type, h_tm, t_prop, t_seg, t_lo, t_hi, h_mt, m_prop, m_seg, m_lo, m_hi``.

    By which directed Hausdorff distances are within ``distance``: both, '1:1';
    target to match only, 'm:1' (the part of the match beside the target); match
    to target only, '1:n' (the part of the target beside the match); neither,
    'm:n' (parts of both, if these are near each other both ways). What is matched
    must differ in length by less than (1 - tolerance) of the target's and, on
    demand, in the direction of its long axis.
    """
    t = targets.select("id", "geometry").where(F.col("id").isNotNull() & (F.size("geometry") > 1)).dropDuplicates(["id"])
    m = matches.select("id", "geometry").where(F.col("id").isNotNull() & (F.size("geometry") > 1)).dropDuplicates(["id"])
    pairs = grid_join(t, m, box_of(F.col("geometry"), distance), box_of(F.col("geometry")), cell or max(8 * distance, 64.0))
    rows = pairs.select(F.col("a.id").alias("target_id"), F.col("b.id").alias("match_id"), F.col("a.geometry").alias("g"), F.col("b.geometry").alias("h"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("target_id", "match_id")]
    schema = (
        f"target_id {kinds[0]}, match_id {kinds[1]}, match_type string, h_tm double, t_prop double, t_seg {shapes.LINE}, t_lo double, t_hi double, "
        f"h_mt double, m_prop double, m_seg {shapes.LINE}, m_lo double, m_hi double"
    )
    return spread(rows, "target_id", "match_id").mapInArrow(_classifier(distance, azimuth_tolerance, length_tolerance), schema)


def _classifier(distance: float, azimuth_tolerance: float | None, length_tolerance: float):
    """Batches of candidate pairs to the classified ones. Measuring and cutting both lines of a pair
    shares so many steps that one Arrow pass over numpy plans and runs faster than nested column lambdas."""

    def direction_fits(a: np.ndarray, b: np.ndarray) -> bool:
        if not azimuth_tolerance:
            return True
        gap = abs(shapes.axis_azimuth(a) - shapes.axis_azimuth(b)) % 360
        gap = min(gap, 360 - gap)
        return min(gap, 180 - gap) <= azimuth_tolerance

    def classify(g: np.ndarray, h: np.ndarray) -> tuple | None:
        mg, mh = _measures(g), _measures(h)
        if mg[-1] <= 0 or mh[-1] <= 0:
            return None
        tm, mt = _stray(g, h), _stray(h, g)
        whole_t, whole_m = tm <= distance, mt <= distance
        kind = {(True, True): "1:1", (True, False): "m:1", (False, True): "1:n", (False, False): "m:n"}[whole_t, whole_m]
        t_ref = (0.0, float(mg[-1])) if whole_t else _beside(h, g, mg, snap=distance)
        m_ref = (0.0, float(mh[-1])) if whole_m else _beside(g, h, mh)
        if t_ref is None or m_ref is None:
            return None
        t_seg, m_seg = (g if whole_t else _part(g, mg, *t_ref)), (h if whole_m else _part(h, mh, *m_ref))
        long_t, long_m = t_ref[1] - t_ref[0], m_ref[1] - m_ref[0]
        if not abs(long_m - long_t) < (1 - length_tolerance) * long_t:
            return None
        if kind != "1:1":
            tm, mt = _stray(t_seg, m_seg), _stray(m_seg, t_seg)
        if kind == "m:n" and (tm > distance or mt > distance) or not direction_fits(t_seg, m_seg):
            return None
        return kind, tm, (1.0 if whole_t else long_t / mg[-1]), t_seg, *t_ref, mt, (1.0 if whole_m else long_m / mh[-1]), m_seg, *m_ref

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        types = [pa.string(), pa.float64(), pa.float64(), line, pa.float64(), pa.float64(), pa.float64(), pa.float64(), line, pa.float64(), pa.float64()]
        names = ["target_id", "match_id", "match_type", "h_tm", "t_prop", "t_seg", "t_lo", "t_hi", "h_mt", "m_prop", "m_seg", "m_lo", "m_hi"]
        for batch in batches:
            kept, got = [], []
            for k, (g, h) in enumerate(zip(_line_arrays(batch.column("g")), _line_arrays(batch.column("h")))):
                if (row := classify(g, h)) is not None:
                    kept.append(k)
                    got.append([[{"x": float(x), "y": float(y)} for x, y in v] if isinstance(v, np.ndarray) else v for v in row])
            at = pa.array(kept, pa.int64())
            columns = [pa.array([r[n] for r in got], t) for n, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("target_id").take(at), batch.column("match_id").take(at), *columns], names=names)

    return run


def _line_arrays(lines: pa.Array) -> Iterator[np.ndarray]:
    points = lines.flatten()
    xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")])
    end = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    return iter(np.split(xy, end[:-1]))


def _beside(a: np.ndarray, b: np.ndarray, m: np.ndarray, snap: float = 0.0) -> tuple[float, float] | None:
    """Where along ``b`` (measured by ``m``) it runs beside ``a``: cut at the places nearest to the ends of ``a``,
    unless these are ends of ``b`` or within ``snap`` of one, the piece that ``a`` strays least from."""
    limit, edge = max(_measures(a)[-1], m[-1]), max(snap, 0.5e-6)
    cuts = sorted(place for far, place in (_nearest(a[0], b, m), _nearest(a[-1], b, m)) if far < limit and edge < place < m[-1] - edge)
    if not cuts:
        return None
    bounds = [0.0, *cuts, float(m[-1])]
    lo, hi = min(zip(bounds, bounds[1:]), key=lambda p: _stray(a, _part(b, m, *p)))
    return (lo, hi) if hi - lo > 1e-9 else None


_MEASURES = ["match_id", "match_type", "h_tm", "t_prop", "h_mt", "m_prop", "m_seg", "m_lo", "m_hi"]


def unmatched_parts(pairs: DataFrame, targets: DataFrame, least: float = 1.0) -> DataFrame:
    """The stretches of partly matched targets that no match covers, longer than ``least``, as rows without a match."""
    part = pairs.groupBy("target_id").agg(F.min("t_prop").alias("_least"), merge_intervals(F.collect_list(F.struct(F.least("t_lo", "t_hi").alias("lo"), F.greatest("t_lo", "t_hi").alias("hi")))).alias("_done")).where("_least < 1")
    own = part.join(targets.select(F.col("id").alias("target_id"), "geometry").dropDuplicates(["target_id"]), "target_id")
    total = L.length(F.col("geometry"))
    starts = F.concat(F.array(F.lit(0.0)), F.col("_done.hi"))
    ends = F.concat(F.col("_done.lo"), F.array(total))
    gaps = own.select("target_id", "geometry", F.inline(F.arrays_zip(starts.alias("t_lo"), ends.alias("t_hi")))).where(F.col("t_hi") - F.col("t_lo") > least)
    none = {n: F.lit(None).cast(k) for n, k in pairs.dtypes if n in _MEASURES}
    return gaps.withColumn("t_seg", L.stretch(F.col("geometry"), F.col("t_lo"), F.col("t_hi"))).withColumns(none).select(*pairs.columns)


def closest_matches(pairs: DataFrame) -> DataFrame:
    """Of rows for the same stretch of a target, the one nearest in either direction; ties go to the lower match id."""
    order = Window.partitionBy("target_id", "t_lo", "t_hi").orderBy(F.least("h_tm", "h_mt").asc_nulls_last(), "match_id")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


# --- sharing a match feature out among targets -----------------------------


def _xy(points: Iterable) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], dtype=float)


def _measures(g: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(g, axis=0).T))])


def _nearest(p: np.ndarray, g: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    a, d = g[:-1], np.diff(g, axis=0)
    n = (d * d).sum(axis=1)
    t = np.clip(((p - a) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
    far = np.hypot(*(p - a - t[:, None] * d).T)
    k = int(far.argmin())
    return float(far[k]), float(m[k] + t[k] * np.sqrt(n[k]))


def _stray(a: np.ndarray, b: np.ndarray) -> float:
    """How far the farthest vertex of ``a`` lies from ``b``, all vertices against all segments at once."""
    s, d = b[:-1], b[1:] - b[:-1]
    n = (d * d).sum(axis=1)
    v = a[:, None, :] - s[None, :, :]
    t = np.clip((v * d).sum(axis=2) / np.where(n > 0, n, 1.0), 0.0, 1.0)
    v -= t[:, :, None] * d
    return float(np.sqrt((v * v).sum(axis=2).min(axis=1).max()))


def _part(g: np.ndarray, m: np.ndarray, lo: float, hi: float) -> np.ndarray:
    at = lambda d: np.array([np.interp(d, m, g[:, 0]), np.interp(d, m, g[:, 1])])
    return np.vstack([at(lo), g[(m > lo) & (m < hi)], at(hi)])


def _share_out(rows: pd.DataFrame) -> pd.DataFrame:
    """One match feature's rows: where they overlap, each piece between the targets' ends goes to the nearest target."""
    rows = rows.sort_values(["m_lo", "m_hi", "target_id", "t_lo"]).reset_index(drop=True)
    g = _xy(rows.h[0])
    m = _measures(g)
    lo, hi = np.minimum(rows.m_lo, rows.m_hi).to_numpy(), np.maximum(rows.m_lo, rows.m_hi).to_numpy()
    groups, reach = [], -np.inf
    for k in np.lexsort((hi, lo)):
        if lo[k] > reach or not groups:
            groups.append([])
        groups[-1].append(k)
        reach = max(reach, hi[k])
    out = rows.drop(columns=["h"]).astype({"match_id": object})
    for group in (x for x in groups if len(x) > 1):
        start, end = lo[group].min(), hi[group].max()
        segs = {k: _xy(rows.t_seg[k]) for k in group}
        cuts = {start, end} | {min(max(_nearest(p, g, m)[1], start), end) for s in segs.values() for p in (s[0], s[-1])}
        cuts = sorted(cuts)
        runs: list[list] = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a <= 1e-9:
                continue
            piece = _part(g, m, a, b)
            winner = min(group, key=lambda k: (min(_stray(piece, segs[k]), _stray(segs[k], piece)), k))
            if runs and runs[-1][0] == winner:
                runs[-1][2] = b
            else:
                runs.append([winner, a, b])
        longest = {}
        for winner, a, b in runs:
            if winner not in longest or b - a > longest[winner][1] - longest[winner][0]:
                longest[winner] = a, b
        for k in group:
            if k in longest:
                a, b = longest[k]
                piece = _part(g, m, a, b)
                out.at[k, "m_lo"], out.at[k, "m_hi"], out.at[k, "m_prop"] = a, b, (b - a) / m[-1]
                out.at[k, "m_seg"] = [{"x": float(x), "y": float(y)} for x, y in piece]
                out.at[k, "h_tm"], out.at[k, "h_mt"] = _stray(segs[k], piece), _stray(piece, segs[k])
            else:
                for name in _MEASURES:
                    out.at[k, name] = None
    return out


def closest_targets(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Each stretch of a match feature left with one target, the nearest; targets that lose all keep their row without a match.

    A target that wins several separate stretches keeps the longest. Only match
    features with more than one target go through Python, each by itself: what
    meets there is bounded by the targets beside one feature.
    """
    pairs = checkpointed(pairs)  # measured once, read by the counts and both kinds of match features
    counts = pairs.where("match_id is not null").groupBy("match_id").agg(F.count("*").alias("_n")).where("_n > 1")
    counted = pairs.where("match_id is not null").join(counts, "match_id", "left").select(*pairs.columns, F.coalesce("_n", F.lit(1)).alias("_n"))
    shared = counted.where("_n > 1").drop("_n").join(matches.select(F.col("id").alias("match_id"), F.col("geometry").alias("h")).dropDuplicates(["match_id"]), "match_id").select(*pairs.columns, "h")
    schema = ", ".join(f"{n} {k}" for n, k in pairs.dtypes)
    return pairs.where("match_id is null").unionByName(counted.where("_n < 2").drop("_n")).unionByName(shared.groupBy("match_id").applyInPandas(_share_out, schema))


def match_by_hausdorff(
    targets: DataFrame,
    matches: DataFrame,
    distance: float,
    azimuth_tolerance: float | None = None,
    length_tolerance: float = 0.0,
    closest_match: bool = False,
    closest_target: bool = False,
    stats: bool = False,
    vectors: bool = False,
    fields: Sequence[str] | bool = (),
    suffix: str = "_match",
    strings: tuple[str, str] | None = None,
    only_candidates: bool = False,
) -> DataFrame:
    """Targets (``id, geometry, ...``), a row for each matched or unmatched stretch, with ``match_id`` and ``match_type``.

    ``geometry`` is the stretch. ``stats`` adds distances, shares, segments and
    places; ``vectors`` the line between the two middles; ``strings`` = (target
    column, match column) a likeness of standardised names. ``only_candidates``
    leaves out targets without any match. ``closest_match`` keeps the nearest of
    several matches of one stretch, ``closest_target`` also leaves each stretch of
    a match feature to one target. Targets without length or geometry keep their
    row unmatched.
    """
    pairs = hausdorff_pairs(targets, matches, distance, azimuth_tolerance, length_tolerance)
    rows = pairs.unionByName(unmatched_parts(pairs, targets))
    if closest_match or closest_target:
        rows = closest_matches(rows)
    if closest_target:
        rows = closest_targets(rows, matches)
    joined = targets.join(rows.withColumnRenamed("target_id", "id"), "id", "inner" if only_candidates else "left")
    joined = joined.withColumn("geometry", F.coalesce("t_seg", "geometry"))
    if vectors:
        joined = joined.withColumn("match_vector", F.when(F.col("m_seg").isNotNull(), F.array(L.midpoint(F.col("geometry")), L.midpoint(F.col("m_seg")))))
    if strings:
        theirs = matches.select(F.col("id").alias("match_id"), F.col(strings[1]).alias("_their")).dropDuplicates(["match_id"])
        joined = staged(joined.join(theirs, "match_id", "left"), {"_a": standardize_streetname(F.col(strings[0])), "_b": standardize_streetname(F.col("_their"))})
        joined = joined.withColumn("name_score", name_score(F.col("_a"), F.col("_b"))).drop("_their", "_a", "_b")
    joined = _attach_fields(joined, matches, fields, suffix)
    return joined if stats else joined.drop("h_tm", "t_prop", "t_seg", "t_lo", "t_hi", "h_mt", "m_prop", "m_seg", "m_lo", "m_hi")
