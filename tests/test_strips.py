"""Detailed polygons: matches by strips equal those of whole outlines."""
import math
import random

import pytest
from pyspark.sql import functions as F

from geoweft.functions import geometry as geo
from geoweft.operators import grid, joins, strips


def ring(points):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + ")"


def star(cx, cy, n, seed):
    """A spiky outline on whole numbers, with level and upright edges among the others."""
    r = random.Random(seed)
    return [(cx + round(k * math.cos(2 * math.pi * i / n)), cy + round(k * math.sin(2 * math.pi * i / n)))
            for i in range(n) for k in [r.choice([400, 700, 900])]]


def comb(teeth, turned):
    """All teeth as long as the comb is high: cut the wrong way, every strip holds every edge."""
    points = [(0, -10)]
    for t in range(teeth):
        points += [(4 * t, 0), (4 * t, 1000), (4 * t + 2, 1000), (4 * t + 2, 0)]
    points.append((4 * teeth, -10))
    return [(y, x) for x, y in points] if turned else points


SHAPES = [
    ("star", f"POLYGON ({ring(star(0, 0, 500, 1))}, {ring(star(0, 0, 300, 2)[::-1])})"),
    ("two", f"MULTIPOLYGON (({ring(star(2500, 0, 200, 3))}), ({ring(star(2500, 2500, 200, 4))}))"),
    ("comb", f"POLYGON ({ring(comb(100, False))})"), ("level comb", f"POLYGON ({ring(comb(100, True))})"),
    ("plain", "POLYGON ((0 0, 500 0, 500 500, 0 500, 0 0))"), ("line", "LINESTRING (0 0, 300 300)"), ("dot", "POINT (4 1000)"),
]


def scattered():
    r = random.Random(5)
    corners = [p for p in star(0, 0, 500, 1)[:60] + comb(100, False)[:60] + comb(100, True)[-60:]]
    free = [(r.randint(-950, 3400), r.randint(-950, 3400)) for _ in range(200)] + [(r.randint(-20, 420), r.randint(-20, 420)) for _ in range(100)]
    return [(f"p{i}", f"POINT ({x} {y})") for i, (x, y) in enumerate(corners + free)] + [("none", "POINT EMPTY")]


@pytest.mark.parametrize(("predicate", "turned"), [("intersects", False), ("within", False), ("contains", True)])
def test_strips_equal_whole_outlines(spark, features, monkeypatch, predicate, turned):
    sides = [features([*scattered(), ("path", "LINESTRING (-1 -1, 2 -1)")]), features(SHAPES)]
    base, source = sides[::-1] if turned else sides
    found = []
    for edges in (20, 10**9):
        monkeypatch.setattr(strips, "DETAILED_EDGES", edges)
        rows = joins.spatial_join(base, source, {"other": "name"}, predicate, match="all").collect()
        found.append(sorted((r.name, r.other or "") for r in rows))
    assert found[0] == found[1]
    assert any(other for _, other in found[0])


def test_points_share_no_area_with_outlines(features, monkeypatch):
    monkeypatch.setattr(strips, "DETAILED_EDGES", 20)
    points = [("p", "POINT (1 -5)"), ("q", "POINT (3000 -5)")]
    out = joins.spatial_join(features(points), features(SHAPES), {"zone": "name"}, on_multiple="largest_overlap")
    # the star's hole holds p, the comb's back does too
    assert sorted((r.name, r.zone) for r in out.collect()) == [("p", "comb"), ("q", None)]


def test_a_point_meets_few_edges_and_copies_are_bounded(spark):
    """Edges over all strips stay within a multiple of the outline's, combs included."""
    for points in (star(0, 0, 5000, 6), comb(1000, False), comb(1000, True)):
        df = spark.createDataFrame([(1, f"POLYGON ({ring(points)})")], "id long, w string")
        from geoweft.functions import text

        shape = df.select("id", F.expr(text.from_wkt("w")).alias("g")).select("id", F.expr(geo.bbox("g")).alias("box"), F.expr(geo.segments("g")).alias("segs"))
        _, parts = strips._cut(grid.stored(shape))
        held = [len(r.edges) for r in parts.collect()]
        assert sum(held) <= (strips.MOST_COPIES + 1) * len(points)
        if len(points) != 5000:  # combs are cut between their teeth
            assert max(held) < 100
    assert strips.located(grid.stored(shape.limit(0)), grid.stored(shape)).count() == 0
