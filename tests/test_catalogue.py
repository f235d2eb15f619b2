"""Queries held against their SQL on the smallest tables, where these are at hand."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("WAYLOOM_TESTDATA", "/root/testdata/sf0.001")
HELD = [
    "nearest_supplier", "points_in_rect_count", "rect_area_weighted_extensive", "conflate_midpoint", "conflate_hausdorff_whole", "closest_on_network", "azimuth_diff_inverse", "segment_intersections",
    "line_length", "spaced_points_space", "split_lines_equal", "osm_speed_limit", "osm_off_street_path", "street_type_std", "merge_intervals", "run_groups", "turns_build", "backward_edges", "route_summary", "sssp_small", "nodes_from_edges",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(HELD) <= set(entry.oracle_sql())


def _plain(value):
    if value is None or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", HELD)
def test_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got = entry.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == names
    expected = Counter(tuple(_plain(row[at.index(n)]) for n in names) for row in want.fetchall())
    assert Counter(tuple(_plain(row[n]) for n in names) for row in got.collect()) == expected
    assert math.isfinite(len(expected))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_merge_multiline_keeps_long_lines(spark, tmp_path):
    line = [(float(k), 0.0) for k in range(1500)]
    spark.createDataFrame([(1, line), (2, line[:3])], "ord int, geometry array<struct<x:double,y:double>>").write.parquet(str(tmp_path / "edges.parquet"))
    got = entry.queries()["merge_multiline"](spark, str(tmp_path)).collect()
    assert {(x.ord, x.lines, x.vertices) for x in got} == {(1, 1, 1500), (2, 1, 3)}
