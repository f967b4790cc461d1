"""Work that grows with the rows: what is shuffled for a join, a coverage or a union."""
import random

import pytest
from pyspark.sql import functions as F

from geoweft.functions import kernels
from geoweft.operators import grid, joins, overlay, polygons


def squares(features, boxes):
    return features([(n, f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))") for n, x, y, w in boxes])


def test_rows_have_no_cells_that_nothing_can_meet(spark):
    df = grid._with_level(spark.range(4).select("id", F.expr("named_struct('xmin', 16D * id, 'ymin', 0D, 'xmax', 16D * id + 9, 'ymax', 9D)").alias("box")))
    assert {r.tag for r in grid._with_cells(df, 0, [4], strict=True).select("cell.tag").collect()} == {0}
    assert {r.tag for r in grid._with_cells(df, 1, [4], strict=False).select("cell.tag").collect()} == {0}
    assert {r.tag for r in grid._with_cells(df, 0, [9], strict=True).select("cell.tag").collect()} == {1}
    assert {r.tag for r in grid._with_cells(df, 1, [2, 9], strict=False).select("cell.tag").collect()} == {0, 1}


def test_vertices_without_others_near_them_are_not_joined(features, shown, monkeypatch):
    df = squares(features, [("a", 0, 0, 10), ("b", 9, 0, 10), ("c", -0.0, 20, 5)])
    expected = shown(polygons.clean_coverage(df), "name")
    assert expected == [("a", 100), ("b", 90), ("c", 25)]
    monkeypatch.setattr(polygons, "_lowest_reached", None)
    assert shown(polygons.clean_coverage(df), "name") == expected


def test_vertices_over_edges_follow_what_moved(features, shown):
    df = squares(features, [("a", 0, 0, 10), ("b", 10.01, 0, 10), ("c", 10.02, 10.01, 5)])
    found = shown(polygons.clean_coverage(df, snap_distance=0.05), wkt=True)
    assert [r[1] for r in found] == [pytest.approx(100, abs=0.2), pytest.approx(100.1, abs=0.2), pytest.approx(25.05, abs=0.2)]
    assert found[1][0] == "POLYGON ((10 0, 20.01 0, 20.01 10, 15.02 10.01, 10 10, 10 0))"


def parts_of(df):
    """Groups with their polygons, each as its shell and its holes, without the place a ring begins at."""
    turned = lambda r: min(tuple(r[i:] + r[:i]) for i in range(len(r)))
    ring = lambda r: turned([(v.x, v.y) for v in r[:-1]])
    return {row.k: sorted((ring(p.rings[0]), sorted(map(ring, p.rings[1:]))) for p in row.parts) for row in df.collect()}


@pytest.mark.parametrize("tile_edges", [20, 2_000])
def test_blocks_and_tiles_find_the_union_of_all_edges(features, monkeypatch, tile_edges):
    rng = random.Random(5)
    rows = [(str(i % 2), rng.randrange(20) * 200 + rng.randrange(40), rng.randrange(120), rng.choice((3, 9, 14, 20))) for i in range(600)]
    frames = [("0", f"POLYGON(({x} 800,{x + 40} 800,{x + 40} 840,{x} 840,{x} 800),({x + 3} 803,{x + 3} 837,{x + 37} 837,{x + 37} 803,{x + 3} 803))") for x in range(500, 900, 60)]
    islands = [("0", x + 15, 815, 9) for x in range(500, 900, 60)] + [("0", 1000, 805, 20), ("0", 1000, 805, 20)]
    shapes = [(n, f"POLYGON(({x} {y},{x + w} {y},{x + w} {y + w},{x} {y + w},{x} {y}))") for n, x, y, w in rows + islands]
    df = features(shapes + frames + [("0", "POLYGON((1000 900,1020 907,1010 920,1000 900))"), ("0", "POLYGON((1005 895,1030 910,1001 918,1005 895))")])
    df = df.selectExpr("name AS k", "geom")
    monkeypatch.setattr(overlay, "ROW_FACES", 500)
    with monkeypatch.context() as m:
        m.setattr(overlay, "_in_blocks", lambda rows: (None, rows))
        expected = parts_of(overlay.union_parts(df))
    monkeypatch.setattr(overlay, "_labelled_pieces", None)  # edges aren't joined with each other
    monkeypatch.setattr(overlay, "TILE_EDGES", tile_edges)
    monkeypatch.setattr(overlay, "ROW_EDGES", 400)
    assert parts_of(overlay.union_parts(df)) == expected
    assert len(expected["0"]) > 60 and sum(len(holes) > 0 for _, holes in expected["0"]) >= 7


def test_crowded_groups_are_joined_by_their_edges(features, monkeypatch):
    df = squares(features, [("a", x % 7, x // 7, 5) for x in range(49)]).selectExpr("name AS k", "geom")
    monkeypatch.setattr(overlay, "ROW_FACES", 100)
    local, wide = overlay._in_blocks(df)
    assert local is None and wide.count() == 49
    assert parts_of(overlay.union_parts(df)) == {"a": [(((0, 0), (11, 0), (11, 11), (0, 11)), [])]}


def test_a_hole_waits_for_a_shell_across_tiles():
    ring = lambda *v: [(*a, *b) for a, b in zip(v, v[1:] + v[:1])]
    shell, hole = ring((0, 0), (30, 0), (30, 10), (0, 10)), ring((2, 2), (2, 8), (8, 8), (8, 2))
    island = ring((4, 4), (6, 4), (6, 6), (4, 6))
    polygons_, rest = kernels.closed_in_tile(shell + hole + island, lambda x, y: x < 20)
    assert polygons_ == [[[(4, 4), (6, 4), (6, 6), (4, 6)]]] and sorted(rest) == [0, 3, 4, 5, 6, 7]
    polygons_, rest = kernels.closed_in_tile(shell + hole + island, lambda x, y: True)
    assert [len(p) for p in polygons_] == [1, 2] and not rest
    assert kernels.closed_in_tile(shell[:2] + hole, lambda x, y: True)[0] == []


@pytest.mark.parametrize("many", [1 << 20, 1])
def test_rows_dropped_before_a_join_meet_nothing(features, monkeypatch, many):
    monkeypatch.setattr(grid, "MANY_BOXES", many)
    rng = random.Random(3)

    def boxes(n, sizes, lowest=-4000):
        return [(str(i), rng.randrange(lowest, 4000), rng.randrange(-4000, 4000), rng.choice(sizes)) for i in range(n)]

    def touch(a, b):
        return all(a[i] <= b[i] + b[3] and b[i] <= a[i] + a[3] for i in (1, 2))

    for rows, others in (
        (boxes(400, (1, 5, 40)), boxes(60, (1, 3))), (boxes(200, (1, 0.125, 9000)), boxes(30, (0.25, 300))),
        (boxes(100, (8, 1)), [("0", 16, 16, 16)]), ([("0", 0, 0, 16), ("1", 32, 32, 1), ("2", 33, 0, 1)], [("0", 16, 16, 16)]), (boxes(50, (2,)), []),
    ):
        near = grid.shapes(squares(features, others)).drop("geom")
        kept = {r.name for r in grid.meeting(squares(features, rows), near).collect()}
        met = {r[0] for r in rows if any(touch(r, o) for o in others)}
        assert met <= kept and len(kept) <= len(met) + 0.3 * len(rows)


def test_shapes_out_of_reach_are_not_stored_for_a_spatial_join(features, monkeypatch):
    base = features([(str(i), f"POINT({i * 1000} 5)") for i in range(20)])
    source = squares(features, [(str(i), i * 20, 0, 10) for i in range(1000)])
    seen, pairs = [], joins.overlapping_pairs
    monkeypatch.setattr(joins, "overlapping_pairs", lambda l, r: seen.append(r.count()) or pairs(l, r))
    found = joins.spatial_join(base, source, {"hit": "name"})
    assert [(r.name, r.hit) for r in found.orderBy("__src_row").collect()] == [(str(i), str(i * 50)) for i in range(20)]
    assert joins.spatial_join(base, source, {"hit": "name"}, match="all").filter("hit IS NOT NULL").count() == 20
    assert len(seen) == 2 and max(seen) < 100


def test_a_grown_shape_of_one_row_is_not_joined_to_it(features, shown):
    shapes = [("a", 0, 0, 10), ("b", 20, 0, 10), ("c", 50, 0, 4)]
    alone = polygons.buffer(squares(features, shapes).withColumn("a b", F.struct("name")), -2.0)
    assert "Join" not in alone._jdf.queryExecution().executedPlan().toString()
    assert shown(alone, "name", "`a b`.name") == [("a", "a", 36), ("b", "b", 36), ("c", "c", 0)]
    # copies, rows that come twice, and columns of no type
    twice = squares(features, [*shapes, ("d", 20, 0, 10), ("e", 50, 0, 4)]).union(squares(features, [("a", 0, 0, 10)]))
    assert shown(polygons.buffer(twice, -2.0), "name") == [("a", 36), ("a", 36), ("b", 36), ("c", 0), ("d", 36), ("e", 0)]
    assert shown(polygons.buffer(squares(features, shapes).withColumn("nothing", F.lit(None)), -2.0), "name", "nothing") == [
        ("a", None, 36), ("b", None, 36), ("c", None, 0)]
