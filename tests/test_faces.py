"""Unions and differences within a row, and joins of stored tables that mustn't be broadcast."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweft.functions import geometry as geo
from geoweft.functions import kernels
from geoweft.operators import lines, overlay, polygons

SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0))"
SHAPES = [
    ("square", SQUARE), ("holed", "POLYGON((20 0,40 0,40 20,20 20,20 0),(26 6,34 6,34 14,26 14,26 6))"),
    ("bent", "POLYGON((50 0,70 0,70 4,54 4,54 20,50 20,50 0))"), ("two", "MULTIPOLYGON(((80 0,85 0,85 5,80 5,80 0)),((87 0,92 0,92 5,87 5,87 0)))"),
    ("line", "LINESTRING(0 40,10 40,10 50)"), ("dots", "MULTIPOINT((0 60),(3 60))"), ("dot", "POINT(0 80)"), ("none", "POLYGON EMPTY"), ("null", None),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simplified_coverage_is_merged(features):
    df = features([("a", SQUARE), ("b", "POLYGON((10 0,20 0,20 10,10 10,10 0))")])
    assert "Broadcast" not in plan(lines.simplify(df, 2.0, shared_boundaries=True))


def test_buffer_merges_what_it_grew(features):
    assert "Broadcast" not in plan(polygons.buffer(features(SHAPES), 2.0))


def test_cleaned_coverage_is_merged(features):
    df = features([("a", SQUARE), ("b", "POLYGON((9 0,20 0,20 10,9 10,9 0))")])
    assert "Broadcast" not in plan(polygons.clean_coverage(df))


@pytest.mark.parametrize("distance", [2.0, -2.0])
def test_buffer_of_few_segments_stays_in_its_row(features, shown, monkeypatch, distance):
    found = shown(polygons.buffer(features(SHAPES), distance), "name")
    # the same by edges that are joined with each other
    with monkeypatch.context() as m:
        for module in (polygons, overlay):
            m.setattr(module, "ROW_FACES", 0)
        assert shown(polygons.buffer(features(SHAPES), distance), "name") == found
    for name in ("union_geometry", "difference_parts"):
        monkeypatch.setattr(polygons, name, None)
    assert shown(polygons.buffer(features(SHAPES), distance), "name") == found


def test_groups_of_few_edges_stay_in_their_rows(features, monkeypatch):
    rows = [
        (0, "a", SQUARE), (0, "b", "POLYGON((5 5,15 5,15 15,5 15,5 5))"), (0, "b", "POLYGON((0 0,2 0,2 2,0 2,0 0))"), (1, "a", SQUARE), (1, "b", SQUARE),
        (2, "a", "POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,3 6,6 6,6 3,3 3))"), (2, "b", "POLYGON((9 2,8 3,9 4,10 3,9 2))"),
        (2, "b", "POLYGON((9 2,8 3,9 4,10 3,9 2))"), (3, "a", "POLYGON((0 0,4 0,4 4,0 0))"), (3, "b", "POLYGON((0 0,4 0,0 4,0 0))"),
    ]
    df = features([(f"{k} {side}", w) for k, side, w in rows]).selectExpr("split(name, ' ')[0] AS k", "split(name, ' ')[1] AS side", "geom")

    def results():
        sizes = F.expr(f"round({geo.area(geo.from_parts('parts'))}, 9) AS area")
        return [sorted(map(tuple, made.select("k", sizes, F.expr("size(parts)")).collect())) for made in (overlay.union_parts(df.drop("side")), overlay.difference_parts(df))]

    with monkeypatch.context() as m:
        m.setattr(overlay, "ROW_FACES", 4)  # some of the groups
        mixed = results()
        m.setattr(overlay, "ROW_FACES", 0)
        assert results() == mixed
    monkeypatch.setattr(overlay, "_cut_edges", None)
    assert results() == mixed
    assert mixed[1] == [("0", 71.0, 1), ("2", 71.0, 1), ("3", 4.0, 1)]


def test_long_boundaries_are_followed_one_at_a_time():
    n, rows = 5_000, 20
    at = np.arange(n) * 2 * np.pi / n
    x, y = np.cos(at), np.sin(at)
    ends = [np.tile(c, rows) for c in (x, y, np.roll(x, -1), np.roll(y, -1))]
    edges = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * n, pa.StructArray.from_arrays([pa.array(c) for c in ends], ["x1", "y1", "x2", "y2"]))
    tracemalloc.start()
    try:
        found = pa.array(kernels.polygons_from_edges(edges))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(parts) for parts in found] == [1] * rows
    assert peak < 200 * n * rows  # bytes; all at once took 400 an edge
