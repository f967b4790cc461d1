"""Validity and repair of polygons: known shapes, random rings against plain definitions, and work that stays near linear."""
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweft.functions import geometry as geo
from geoweft.functions import planar
from geoweft.functions.wkb import PART_ARROW
from geoweft.operators import overlay


def part(*rings):
    return {"dim": 2, "rings": [[{"x": float(x), "y": float(y), "z": None} for x, y in r] for r in rings]}


def arrow(*geometries):
    return pa.array(geometries, pa.list_(PART_ARROW))


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def area(parts):
    total = 0.0
    for p in parts:
        for k, ring in enumerate(p["rings"]):
            xy = [(v["x"], v["y"]) for v in ring]
            a = abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(xy, xy[1:]))) / 2
            total += a if k == 0 else -a
    return total


BROKEN = [
    ("bow tie", [part([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])], 2.0, 2), ("touches itself", [part([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 1), (0, 0)])], 2.0, 2),
    ("spike", [part([(0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4), (0, 0)])], 16.0, 1), ("vertex on own edge", [part([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)])], 8.0, 2),
    ("hole along shell", [part(square(0, 0, 4), [(0, 1), (1, 1), (1, 2), (0, 2), (0, 1)])], 15.0, 1), ("hole across shell", [part(square(0, 0, 4), square(3, 3, 3))], 23.0, 2),
    ("no area", [part([(0, 0), (1, 1), (0, 0)])], 0.0, 0), ("not closed", [part(square(0, 0, 2)[:4])], 4.0, 1), ("twice around", [part(square(0, 0, 2) + square(0, 0, 2)[1:])], 0.0, 0),
    ("two parts, one broken", [part(square(10, 10, 1)), part([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])], 3.0, 3),
]
VALID = [
    [part(square(0, 0, 1))], [part(square(0, 0, 4), square(1, 1, 1), square(2, 2, 1))], [part(square(0, 0, 4), [(0, 0), (1, 2), (2, 1), (0, 0)])], [],
    [part([(0, 0), (1, 0), (1, 0), (2, 0), (2, 2), (0, 0)])], [{"dim": 1, "rings": [[{"x": 0.0, "y": 0.0, "z": None}, {"x": 1.0, "y": 1.0, "z": None}, {"x": 0.0, "y": 0.0, "z": None}]]}],
    [part(square(0, 0, 1)), part(square(1, 1, 1))],
]


@pytest.mark.parametrize("name, shape, size, count", BROKEN, ids=[b[0] for b in BROKEN])
def test_broken_shapes(name, shape, size, count):
    # whatever else is in the batch
    before, found, _, after = planar.mended(arrow(VALID[1], shape, None, VALID[0]))
    assert before is None and after is None
    assert len(found) == count and area(found) == pytest.approx(size)
    assert planar.mended(arrow(found)) == [None]


def test_valid_shapes():
    assert planar.mended(arrow(*VALID)) == [None] * len(VALID)
    assert planar.mended(arrow()) == [] and planar.mended(arrow(None, [])) == [None, None]


def plain_pairs(e):
    b = planar.boxes_of(e)
    return {(i, j) for i in range(len(e)) for j in range(i + 1, len(e)) if (b[i, :2] <= b[j, 2:]).all() and (b[j, :2] <= b[i, 2:]).all()}


@pytest.mark.parametrize("n, most", [(1, 500_000), (7, 500_000), (150, 500_000), (150, 20)])
def test_pairs_are_those_of_overlapping_boxes(monkeypatch, n, most):
    monkeypatch.setattr(planar, "PAIRS", most)
    r = np.random.default_rng(n)
    e = r.integers(0, 30, (n, 4)).astype(float)
    e[:, 2:] = e[:, :2] + r.integers(-3, 4, (n, 2))
    group = np.sort(r.integers(0, 4, n))
    boxes = planar.boxes_of(e)
    pairs = plain_pairs(e)
    got = [(i, j) for a, b in planar.Pyramid(boxes, group).pairs() for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == sorted((i, j) for i, j in pairs if group[i] == group[j])
    asked = [(q, i) for a, b in planar.Pyramid(boxes).met_by(boxes[:20]) for q, i in zip(a.tolist(), b.tolist())]
    assert sorted(asked) == sorted((q, i) for q in range(min(20, n)) for i in range(n) if (min(q, i), max(q, i)) in pairs or q == i)


def winds_odd(ring, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize("seed", range(12))
def test_random_rings_become_their_odd_area(seed):
    r = random.Random(seed)
    grid = 8 if seed % 2 else 1_000
    ring = [(r.randint(0, grid), r.randint(0, grid)) for _ in range(r.randint(4, 14))]
    ring.append(ring[0])
    found = planar.mended(arrow([part(ring)]))[0]
    parts = [part(ring)] if found is None else found
    assert planar.mended(arrow(parts)) == [None]  # what comes out is valid
    for _ in range(300):
        x, y = r.random() * grid, r.random() * grid
        inside = sum(sum(winds_odd([(v["x"], v["y"]) for v in hole], x, y) for hole in p["rings"]) % 2 for p in parts)
        assert inside == winds_odd(ring, x, y), (x, y)


def wavy(n):
    at = [2 * math.pi * i / n for i in range(n)]
    ring = [((10 + math.sin(7 * a) + 1e-4 * math.sin(900 * a)) * math.cos(a), (10 + math.sin(7 * a) + 1e-4 * math.sin(900 * a)) * math.sin(a)) for a in at]
    return [*ring, ring[0]]


def comb(teeth):
    ring = [p for i in range(teeth) for p in ((2 * i, 0), (2 * i, 1000), (2 * i + 1, 1000), (2 * i + 1, 0))]
    return [*ring, (2 * teeth, 0), (2 * teeth, -1), (0, -1), (0, 0)]


@pytest.mark.parametrize("ring", [wavy(100_000), comb(25_000)], ids=["outline", "comb"])
def test_a_large_ring_is_quick(ring):
    table = arrow([part(ring)])
    start = time.process_time()
    assert planar.mended(table) == [None]
    assert time.process_time() - start < 3  # some 0.3 s here
    ring = list(ring)
    ring[500] = (-30.0, ring[500][1] + 5)
    found = planar.mended(arrow([part(ring)]))[0]
    assert found and planar.mended(arrow(found)) == [None]


def test_repair_is_a_column_of_the_scan(spark, features):
    df = features([("bow", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"), ("line", "LINESTRING (0 0, 1 1, 0 0)"), ("ok", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), ("gone", "POLYGON ((0 0, 1 1, 0 0))")])
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    out = overlay.repaired(df)
    assert len(jobs.getJobIdsForGroup()) == before
    got = {r.name: (r.kind, r.area) for r in out.select("name", "geom.kind", F.expr(geo.area("geom")).alias("area")).collect()}
    assert got == {"bow": ("MULTIPOLYGON", 2.0), "line": ("LINESTRING", 0.0), "ok": ("POLYGON", 1.0), "gone": ("POLYGON", 0.0)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
