import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayloom.llm.entities import DEFAULT, Mixture, NameLikeness, Settings, along, calibration, isotonic, matched_sections, measured_pairs, name_core, recorded_lengths, with_confidence
from wayloom.operators.proximity import Shapes

SIDE = "key bigint, g array<struct<x:double,y:double>>, name string, kind string, length double, bin int"


def _town(seed=3, blocks=7):
    """A grid of streets: targets section by section, matches shifted, reversed, renamed, some over two sections, decoys alongside."""
    r = random.Random(seed)
    syllables = ["zan", "tor", "mel", "ki", "ru", "fen", "gal", "dor", "vi", "pes"]
    targets, matches = [], []
    for line in range(blocks):
        name = "".join(r.choice(syllables) for _ in range(4)).title()
        for b in range(blocks):
            key = line * 100 + b
            x0, x1, y = b * 110.0, (b + 1) * 110.0, line * 120.0
            targets.append((key, [(x0, y), ((x0 + x1) / 2, y + 1), (x1, y)], f"{name} Street", "residential", 110.0, 0))
            shift = r.choice([0.5, 2.0, 14.0])
            g = [(x0, y + shift), (x1, y + shift)]
            matches.append((10_000 + key, g[::-1] if r.random() < 0.5 else g, r.choice([f"{name.upper()} ST.", name, f"N {name} St", None if shift < 3 else name]), "L", None, 0))
            if r.random() < 0.3:
                matches.append((20_000 + key, [(x0, y - 11), (x1, y - 11)], "Quincy Alley", "P", 109.0, 0))
        matches.append((30_000 + line, [(0.0, line * 120.0 - 1), (220.0, line * 120.0 - 1)], f"Route {line + 1}", "A", 220.0, 0))
    return targets, matches


def _expected(targets, matches):
    out = set()
    for t in targets:
        for m in matches:
            tx, mx = sorted(p[0] for p in t[1]), sorted(p[0] for p in m[1])
            common = min(tx[-1], mx[-1]) - max(tx[0], mx[0])
            dy = abs(t[1][0][1] - m[1][0][1])
            names = NameLikeness(0.75)(name_core(t[2]), name_core(m[2]))
            if common >= 55 and (dy <= 20 and (names or 0) >= 0.75 or dy <= 5 and names is None):
                out.add((t[0], m[0]))
    return out


def test_pairs(spark):
    targets, matches = _town(blocks=14)
    expected = _expected(targets, matches)
    extra = [(9001, None, "A", "x", 1.0, 0), (9002, [], "A", "x", 1.0, 0), (9003, [(5.0, 5.0)], "A", None, None, 0)]
    a = spark.createDataFrame(targets + targets[:9] + extra, SIDE)
    b = spark.createDataFrame(matches + matches[:9] + extra, SIDE)
    every = {(r.target_id, r.match_id) for r in measured_pairs(a, b, exhaustive=True).collect()}
    for settings, least in ((DEFAULT, 0.97), (Settings(leaf_rows=60), 0.9)):
        kept = matched_sections(a, b, settings).collect()
        got = [(r.target_id, r.match_id) for r in kept]
        assert len(got) == len(set(got)) and len(set(got) & expected) >= least * len(expected) and len(set(got) - expected) <= 0.02 * len(expected)
        assert set(got) <= every and all(settings.least_confidence <= r.confidence < 1 for r in kept)
    assert expected <= every
    assert matched_sections(a.limit(0), b).count() == 0 and matched_sections(a, b.limit(0)).count() == 0
    held = calibration(measured_pairs(a, b)).collect()
    assert sum(r.pairs for r in held) > 0 and all(0 <= r.agreeing <= 1 for r in held)


def test_oversized_leaves_are_split_where_they_are_worked_on(spark):
    """One leaf for all, split in the task, loses nothing against the quadtree's own leaves."""
    from wayloom.llm import entities

    targets, matches = _town(blocks=14)
    a, b = spark.createDataFrame(targets, SIDE), spark.createDataFrame(matches, SIDE)
    original = entities.learn_quadtree
    try:
        entities.learn_quadtree = lambda sides, total, leaf_rows, smallest: original(sides, total, 10**6, smallest)
        split = {(r.target_id, r.match_id) for r in measured_pairs(a, b, Settings(leaf_rows=60)).collect()}
    finally:
        entities.learn_quadtree = original
    every = {(r.target_id, r.match_id) for r in measured_pairs(a, b, exhaustive=True).collect()}
    assert split <= every and len(split) >= 0.93 * len(every)


def test_training_helps_blocking(spark):
    targets, matches = _town(seed=8, blocks=14)
    a, b = spark.createDataFrame(targets, SIDE), spark.createDataFrame(matches, SIDE)
    every = measured_pairs(a, b, exhaustive=True).count()
    trained, random_start = (measured_pairs(a, b, Settings(trained=t, tables=16)).count() / every for t in (True, False))
    assert trained >= 0.9 and trained > random_start


def test_mixture_learns_its_weights():
    r = np.random.default_rng(4)
    n = 20_000
    same = r.random(n) < 0.6
    place = np.where(same, r.integers(4, 9, n), r.integers(0, 7, n))
    offset = np.where(same, r.integers(0, 5, n), r.integers(3, 10, n))
    overlap = r.integers(0, 5, n)
    name = np.where(r.random(n) < 0.3, -1, np.where(same, r.integers(4, 6, n), 0))
    patterns, counts = np.unique(np.column_stack([place, offset, overlap, name]), axis=0, return_counts=True)
    model = Mixture.fit(patterns, counts.astype(float))
    blind = patterns[:, 3] < 0
    got = model.posterior(np.column_stack([place, offset, overlap, name]))
    assert ((got > 0.5) == same)[name >= 0].mean() > 0.99 and ((got > 0.5) == same)[name < 0].mean() > 0.9 and blind.any()
    assert (np.diff(model.ratio[0]) >= -1e-9).all() and (np.diff(model.ratio[1]) <= 1e-9).all()
    assert np.abs(np.log(model.ratio[2])).max() < 0.2  # the overlap says nothing here, so it gets no weight


def test_along():
    a = Shapes.of(np.array([[0, 0], [100, 0], [0, 0], [10, 0]], float), np.array([2, 2]))
    b = Shapes.of(np.array([[50, 3], [150, 3], [100, 0], [200, 0], [5, 5], [5, 50]], float), np.array([2, 2, 2]))
    overlap, offset = along(a, b, np.array([0, 0, 0, 1]), np.array([0, 1, 2, 0]))
    assert math.isclose(overlap[0], 0.5, abs_tol=0.05) and math.isclose(offset[0], 3.0)
    assert overlap[1] == 0 and overlap[2] < 0.05 and overlap[3] == 0 and math.isinf(offset[3])


def test_names_rates_and_lengths(spark):
    assert name_core("N. Zanordale Blvd.") == name_core("zanordale boulevard") == "zanordale"
    assert name_core("Route 17") == name_core(None) == "" and name_core("Lane") == "lane"
    rates = isotonic(np.array([1, 0, 3, 2, 9.0]), np.array([10, 10, 10, 10, 10.0]))
    assert (np.diff(rates) >= 0).all() and math.isclose(rates.sum() * 10, 15)
    targets = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 5.0)], None), (2, [(0.0, 0.0), (5.0, 5.0)], 9.0), (3, None, None), (4, [(1.0, 1.0), (2.0, 2.0)], 0.0)], "id int, geometry array<struct<x:double,y:double>>, length double")
    edges = spark.createDataFrame([([(5.0, 5.0), (0.0, 0.0)], 7.1), ([(0.0, 0.0), (1.0, 4.0), (5.0, 5.0)], 7.2), ([(0.0, 0.0), (5.0, 5.0)], 0.0), (None, 3.0)], "geometry array<struct<x:double,y:double>>, length double")
    got = {r.id: r.length for r in recorded_lengths(targets, edges).select("id", F.col("length")).collect()}
    assert got == {1: 7.2, 2: 9.0, 3: None, 4: None}
