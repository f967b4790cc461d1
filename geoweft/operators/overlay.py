"""Polygon overlay as a dataflow over edges.

Polygons are taken apart into directed edges with the inside on their left. Edges are cut
where they meet, every piece is kept or dropped by what lies beside its middle, and the kept
pieces are followed into rings. Intersecting a pair of geometries happens within its row; for
unions and differences of any number of polygons the edges of a group `k` are joined with
each other by grid cell, so one group may be as large as the whole table."""
from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import faces as row_faces
from ..functions import kernels, noding, planar
from ..functions.wkb import GEOMETRY_ARROW, PART_ARROW
from .chains import assembled, closed_rings
from .grid import FLOOR_LEVEL, MOST_HOT_CELLS, grown, overlapping_pairs, stored

# Edges of one result geometry that are followed into rings within a row; a larger boundary
# is put in order by joins first.
ROW_EDGES = 200_000

# Groups of polygons worked on by a task, and the fewest worth a task of their own.
ROWS_PER_TASK = 10_000
LEAST_ROWS_PER_TASK = 500
# Edges of a group of polygons up to which its union or difference happens within a row.
ROW_FACES = 2_000

# Blocks of the map are as many times (a power of two) as large as the largest polygon of a group.
BLOCK_STEPS = (2, 3, 4, 5, 6)
# Edges of a boundary that lie in a tile of the map on the average, and rounds of tiles.
TILE_EDGES = 5_000
TILE_ROUNDS = 3

EDGE = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
EDGES_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]))
EDGES_ARROW = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))


@F.arrow_udf(T.ArrayType(geo.PART_TYPE))
def _polygons_from_edges(edges: pa.Array, _same: pa.Array) -> pa.Array:
    return kernels.polygons_from_edges(edges)


_polygons_from_edges = _polygons_from_edges.asNondeterministic()


def polygons_from_edges(column: str) -> Column:
    """Polygon parts of an array of edges. Given twice, as for WKB, so that the planner leaves
    the argument's own expression where it is."""
    return _polygons_from_edges(F.col(column), F.col(column))


# ---- within a row: one geometry with another ---------------------------------

def _bare(edges: str) -> str:
    e = geo.var("e")
    return f"transform({edges}, {e} -> named_struct('x1', {e}.x1, 'y1', {e}.y1, 'x2', {e}.x2, 'y2', {e}.y2))"


def common_edges(a: str, b: str, inverse: str) -> str:
    """Directed edges bounding the intersection of two polygons' oriented segments."""
    return f"array_distinct(concat({_bare(noding.inside_edges(a, b, inverse))}, {_bare(noding.inside_edges(b, a, inverse))}))"


def _largest(segs: str) -> str:
    e = geo.var("e")
    return f"array_max(transform({segs}, {e} -> greatest(abs({e}.x1), abs({e}.y1), abs({e}.x2), abs({e}.y2))))"


def _gridded(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows' segment arrays rounded to a precision grid fitting both, `__inv` cells per unit."""
    inv = noding.grid_inverse(f"greatest({_largest(a)}, {_largest(b)})")
    return (
        rows.withColumn("__inv", F.expr(inv))
        .withColumn(a, F.expr(noding.on_grid_segments(a, "__inv"))).withColumn(b, F.expr(noding.on_grid_segments(b, "__inv")))
    )


def pair_areas(pairs: DataFrame) -> DataFrame:
    """(`k`, `area`): the area two segment arrays `a` and `b` have in common."""
    poly = lambda c: f"filter({c}, e -> e.d = 2)"
    ready = pairs.select(
        "k", F.expr(_reoriented("a")).alias("a"), F.expr(_reoriented("b")).alias("b"),
    ).select("k", F.expr(poly("a")).alias("a"), F.expr(poly("b")).alias("b"))
    return _gridded(ready, "a", "b").select("k", F.expr(common_edges("a", "b", "__inv")).alias("edges")).select(
        "k", F.expr(noding.edges_area("edges")).alias("area"),
    )


def _reoriented(segs: str) -> str:
    """Flat segments with polygon edges turned to have the inside on their left."""
    e = geo.var("e")
    return (
        f"transform({segs}, {e} -> CASE WHEN {e}.d = 2 AND {noding.location_beside(segs, e)} <> 1 THEN "
        f"named_struct('d', {e}.d, 'x1', {e}.x2, 'y1', {e}.y2, 'x2', {e}.x1, 'y2', {e}.y1) ELSE {e} END)"
    )


def intersections(pairs: DataFrame) -> DataFrame:
    """`pairs` (with geometries `a` and `b`) plus `geom`: the part of `a` in `b`, of `a`'s own
    dimension; EMPTY when they only touch."""
    p = geo.var("p")
    rows = (
        _gridded(pairs.withColumn("__a", F.expr(noding.oriented("a"))).withColumn("__b", F.expr(noding.oriented("b"))), "__a", "__b")
        .withColumn("__dim", F.expr(geo.dimension("a")))
        .withColumn("__edges", F.expr(f"CASE WHEN __dim = 2 THEN {common_edges('__a', '__b', '__inv')} ELSE CAST(array() AS ARRAY<{EDGE}>) END"))
    )
    areas = polygons_from_edges("__edges")
    lines = noding.runs(noding.line_pieces("__a", "__b"))
    points = f"filter(a.parts, {p} -> {geo.covered('__b', f'{p}.rings[0][0].x', f'{p}.rings[0][0].y')})"
    # stored: the followed rings are used inside lambdas next
    rows = stored(rows.withColumn("__areas", areas)).withColumn(
        "__parts", F.expr(f"CASE __dim WHEN 2 THEN __areas WHEN 1 THEN {lines} ELSE {points} END"),
    )
    return rows.withColumn("geom", F.expr(
        f"CASE WHEN size(__parts) = 0 THEN {geo._geometry('a.kind', '__parts')} ELSE {geo.from_parts('__parts')} END"
    )).drop("__a", "__b", "__inv", "__dim", "__edges", "__areas", "__parts")


# ---- within a row: the few polygons of a group -------------------------------

def spread(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """Rows that cost a task far more than their bytes tell, over tasks by their number (or that
    of their groups `by` columns)."""
    spark = rows.sparkSession
    return rows.repartition(max(1, count // ROWS_PER_TASK, min(spark.sparkContext.defaultParallelism, count // LEAST_ROWS_PER_TASK)), *by)


def face(side: str, parts: str) -> str:
    """A polygon of a group held by a row (`bounded`)."""
    return f"named_struct('side', {side}, 'parts', {parts})"


def bounded(rows: DataFrame, inverse: str, subtract: bool) -> DataFrame:
    """Rows (`k`, `faces`, others) with `parts` for `faces`: the union of each row's polygons or, with
    `subtract`, those of side `a` without those of side `b`."""
    cells = float(inverse.rstrip("D"))

    @F.arrow_udf(T.ArrayType(geo.PART_TYPE))
    def polygons(faces: pa.Array, _same: pa.Array) -> pa.Array:
        done = [kernels.polygons_from_edges(row_faces.boundaries(some, cells, subtract)) for some in row_faces.batches(faces)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(PART_ARROW))

    polygons = polygons.asNondeterministic()  # computed once, behind the argument's expression
    return rows.select(*[c for c in rows.columns if c != "faces"], polygons("faces", "faces").alias("parts"))


def _in_rows(rows: DataFrame, subtract: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows (`k`, `side`, `geom`): the results of groups that a row can hold, and the rows of the
    others; None where there are none."""
    rows = stored(rows.filter("size(geom.parts) > 0").select("k", "side", "geom"))
    p = geo.var("p")
    solid = f"forall(geom.parts, {p} -> {p}.dim = 2)"
    edges = f"CASE WHEN {solid} THEN size({geo.vertices('geom')}) ELSE {ROW_FACES + 1} END"
    sized = rows.groupBy("k").agg(F.sum(F.expr(edges)).alias("n")).withColumn("large", F.col("n") > ROW_FACES)
    groups = stored(sized.select("k", "large"))
    large, every = groups.agg(F.count_if("large"), F.count(F.lit(1))).first()
    if every and large == every:
        return None, rows
    small = rows.join(groups.filter("large").hint("merge"), "k", "left_anti") if large else rows
    packed = spread(small, every - large, "k").groupBy("k").agg(F.collect_list(F.expr(face("side", "geom.parts"))).alias("faces"))
    result = bounded(packed, precision_grid(rows.select(F.expr(geo.bbox("geom")).alias("box"))), subtract).filter("size(parts) > 0")
    return result, rows.join(groups.filter("large").hint("merge"), "k", "left_semi") if large else None


def _both(small: DataFrame | None, large: DataFrame | None) -> DataFrame:
    return large if small is None else small if large is None else small.unionByName(large)


# ---- across rows: the edges of a group ---------------------------------------

def _cut_edges(edges: DataFrame, inverse: str) -> DataFrame:
    """Edges (`k`, `eid`, …, `e`, their ends on the grid) cut at every other edge of their
    group: one row per piece, with the other columns kept and `seq` numbering an edge's
    pieces in order."""
    boxed = stored(edges.withColumn("box", F.expr(
        "named_struct('xmin', least(e.x1, e.x2), 'ymin', least(e.y1, e.y2), "
        "'xmax', greatest(e.x1, e.x2), 'ymax', greatest(e.y1, e.y2))"
    )))
    lean = boxed.select("k", "eid", "e", "box")
    wide = lean.withColumn("box", F.expr(grown("box", f"2D / {inverse}")))
    pairs = overlapping_pairs(wide, lean, on=["k"]).filter("l.eid <> r.eid")
    pairs = pairs.filter("NOT (l.e = r.e)")
    marks = pairs.select("l.k", "l.eid", F.expr(f"inline({noding.cuts('l.e', 'r.e', inverse)})"))
    # only edges that are cut go through the window; a hash leads its keys, as a long sorts fast
    cut_only = marks.distinct().withColumn("h", F.xxhash64("k", "eid"))
    touched = cut_only.select("h", "k", "eid").distinct()
    hashed = lean.withColumn("h", F.xxhash64("k", "eid"))
    ends = hashed.join(touched, ["h", "k", "eid"], "left_semi").select("k", "eid", F.expr(
        "inline(array(named_struct('t', 0D, 'x', e.x1, 'y', e.y1), named_struct('t', 1D, 'x', e.x2, 'y', e.y2)))"
    ), "h")
    whole = hashed.join(touched, ["h", "k", "eid"], "left_anti").select("h", "k", "eid", F.lit(0.0).alias("seq"), "e")
    order = "OVER (PARTITION BY h, k, eid ORDER BY t, x, y)"
    cut = whole.unionByName(
        cut_only.unionByName(ends)
        .withColumn("nx", F.expr(f"lead(x) {order}")).withColumn("ny", F.expr(f"lead(y) {order}"))
        .filter("nx IS NOT NULL AND (x <> nx OR y <> ny)")
        .select("h", "k", "eid", F.col("t").alias("seq"), F.struct(
            F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("nx").alias("x2"), F.col("ny").alias("y2"),
        ).alias("e"))
    )
    rest = [c for c in edges.columns if c not in ("k", "eid", "e")]
    if not rest:
        return cut.drop("h")
    kept = boxed.select("k", "eid", *rest).withColumn("h", F.xxhash64("k", "eid"))
    return kept.join(cut, ["h", "k", "eid"]).drop("h")


def _probe(pieces: DataFrame, faces: DataFrame, x: str, y: str) -> DataFrame:
    """For each piece (`h`, `k`, `pid`) the faces covering its probe point: `in_a`, `in_b`."""
    probes = stored(pieces.select("h", "k", "pid", F.expr(x).alias("px"), F.expr(y).alias("py")).withColumn(
        "box", F.expr("named_struct('xmin', px, 'ymin', py, 'xmax', px, 'ymax', py)"),
    ))
    hits = overlapping_pairs(probes, faces, on=["k"]).filter(F.expr(geo.covered("r.segs", "l.px", "l.py")))
    return hits.groupBy(F.col("l.h").alias("h"), F.col("l.k").alias("k"), F.col("l.pid").alias("pid")).agg(
        F.expr("bool_or(r.side = 'a')").alias("in_a"), F.expr("bool_or(r.side = 'b')").alias("in_b"),
    )


def _faces(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows (`k`, `side`, `geom`) as distinct faces with their box and oriented segments, and
    the precision grid's cells per unit: the segments lie on it."""
    faces = stored(
        rows.filter("size(geom.parts) > 0").select("k", "side", "geom").distinct().select(
            "k", "side", F.expr(geo.bbox("geom")).alias("box"), F.expr(noding.oriented("geom")).alias("segs"),
            F.xxhash64("side", "geom").alias("fid"),
        )
    )
    inverse = precision_grid(faces)
    return faces.withColumn("segs", F.expr(noding.on_grid_segments("segs", inverse))), inverse


def precision_grid(boxed: DataFrame, margin: float = 0.0) -> str:
    """The precision grid for shapes reaching as far as `margin` out of their boxes."""
    largest = boxed.agg(F.max(F.expr("greatest(abs(box.xmin), abs(box.ymin), abs(box.xmax), abs(box.ymax))"))).first()[0]
    return f"1e{min(12, 14 - math.ceil(math.log10(max((largest or 1.0) + margin, 1.0))))}D"


def _edge_rows(faces: DataFrame) -> DataFrame:
    return faces.select(
        "k", "side", "fid", F.posexplode(F.expr("filter(segs, s -> s.d = 2)")).alias("pos", "s"),
    ).select("k", "side", F.struct("fid", "pos").alias("eid"), F.expr(
        "named_struct('x1', s.x1, 'y1', s.y1, 'x2', s.x2, 'y2', s.y2)").alias("e"))


def _labelled_pieces(faces: DataFrame, inverse: str) -> DataFrame:
    pieces = _cut_edges(_edge_rows(faces), inverse).withColumn("pid", F.struct("eid", "seq")).drop("eid", "seq")
    return stored(pieces.withColumn("h", F.xxhash64("k", "pid")))


def union_parts(rows: DataFrame) -> DataFrame:
    """(`k`, `parts`): the union of the polygons of each group `k` (rows `k`, `geom`)."""
    small, large = _in_rows(rows.withColumn("side", F.lit("a")), subtract=False)
    return _both(small, None if large is None else rings(union_edges(large)))


def union_edges(rows: DataFrame) -> DataFrame:
    """(`k`, `e`): the directed boundary of each group's union."""
    local, wide = _in_blocks(rows)
    if wide is None:
        return local
    faces, inverse = _faces(wide.withColumn("side", F.lit("a")))
    pieces = _labelled_pieces(faces, inverse)
    right = noding.beside("e", -1)
    covered = _probe(pieces, faces, *right)
    edges = pieces.join(covered, ["h", "k", "pid"], "left_anti").select("k", "e")
    return edges if local is None else local.unionByName(edges)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_HOT_CELLS else table


def _in_blocks(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows (`k`, `geom`): the boundaries (`k`, `e`) of the unions of groups whose polygons lie on the
    map so that none of its blocks is crowded, and the rows of the others; None where there are none.

    A polygon is at home in the block of its middle, and goes to every block at home in which one
    may be that it meets; so each block can tell what its own polygons' edges add to the boundary."""
    p = geo.var("p")
    edges = f"CASE WHEN forall(geom.parts, {p} -> {p}.dim = 2) THEN size({geo.vertices('geom')}) ELSE {ROW_FACES + 1} END"
    boxed = stored(rows.filter("size(geom.parts) > 0").select("k", "geom", F.expr(geo.bbox("geom")).alias("box"), F.expr(edges).alias("n")))
    inverse = precision_grid(boxed)
    # what is beside an edge is asked for a millionth of its length off it
    groups = boxed.groupBy("k").agg(F.expr("max(box.xmax - box.xmin) / 2").alias("hx"), F.expr("max(box.ymax - box.ymin) / 2").alias("hy")).withColumn(
        "margin", F.expr(f"4D / {inverse} + 1e-5D * (hx + hy)")).withColumn(
        "size", F.expr(f"pow(2D, greatest({FLOOR_LEVEL}, ceil(log2(2 * greatest(hx, hy) + margin))))"))
    groups = stored(groups)
    count = groups.count()
    if not count:
        return None, None
    middle = lambda a: f"CAST(floor((box.{a}min + box.{a}max) / 2 / size) AS BIGINT)"
    cells = (
        boxed.select("k", "box", "n").join(_small(groups.select("k", "size"), count), "k")
        .groupBy("k", F.expr(middle("x")).alias("cx"), F.expr(middle("y")).alias("cy")).agg(F.sum("n").alias("n"))
    )
    # at most what the cells of a block and those around it hold
    near = lambda c: f"array_distinct(transform(sequence({c} - 1, {c} + 1), v -> CAST(floor(v / pow(2D, step)) AS BIGINT)))"
    crowds = (
        cells.select("k", "cx", "cy", "n", F.explode(F.lit(list(BLOCK_STEPS))).alias("step"))
        .select("k", "step", "n", "cy", F.explode(F.expr(near("cx"))).alias("bx")).select("k", "step", "n", "bx", F.explode(F.expr(near("cy"))).alias("by"))
        .groupBy("k", "step", "bx", "by").agg(F.sum("n").alias("n"))
        .groupBy("k", "step").agg(F.max("n").alias("n")).filter(F.col("n") <= ROW_FACES)
    )
    fits = stored(crowds.groupBy("k").agg(F.max("step").alias("step")).join(groups, "k").withColumn("size", F.expr("size * pow(2D, step)")).drop("step"))
    fitting = fits.count()
    wide = None if fitting == count else boxed.join(_small(fits.select("k"), fitting), "k", "left_anti").select("k", "geom")
    if not fitting:
        return None, wide
    reach = lambda a: (
        f"sequence(CAST(floor((box.{a}min - h{a} - margin) / size) AS BIGINT), CAST(floor((box.{a}max + h{a} + margin) / size) AS BIGINT))")
    dealt = (
        boxed.join(_small(fits, fitting), "k")
        .withColumn("cx", F.explode(F.expr(reach("x")))).withColumn("cy", F.explode(F.expr(reach("y"))))
        .select("k", "cx", "cy", F.expr(face(f"CASE WHEN cx = {middle('x')} AND cy = {middle('y')} THEN 'a' ELSE 'b' END", "geom.parts")).alias("face"))
    )
    packed = spread(dealt, boxed.count(), "k", "cx", "cy").groupBy("k", "cx", "cy").agg(F.collect_list("face").alias("faces"))
    grid = float(inverse.rstrip("D"))

    @F.arrow_udf(EDGES_TYPE)
    def own_edges(faces: pa.Array, _same: pa.Array) -> pa.Array:
        done = [row_faces.boundaries(some, grid, False, own=True) for some in row_faces.batches(faces)]
        return pa.concat_arrays(done) if done else pa.array([], EDGES_ARROW)

    own_edges = own_edges.asNondeterministic()  # computed once, behind the argument's expression
    found = packed.filter("exists(faces, f -> f.side = 'a')").select("k", own_edges("faces", "faces").alias("edges"))
    return found.select("k", F.explode("edges").alias("e")), wide


def difference_parts(rows: DataFrame) -> DataFrame:
    """(`k`, `parts`): each group's side `a` polygon minus all its side `b` polygons."""
    small, large = _in_rows(rows, subtract=True)
    return _both(small, None if large is None else rings(_difference_edges(large)))


def _difference_edges(rows: DataFrame) -> DataFrame:
    faces, inverse = _faces(rows)
    pieces = _labelled_pieces(faces, inverse)
    # an edge of `a` is looked at on its inside, an edge of `b` on its outside
    lx, ly = noding.beside("e", 1)
    rx, ry = noding.beside("e", -1)
    x, y = (f"CASE WHEN side = 'a' THEN {a} ELSE {b} END" for a, b in ((lx, rx), (ly, ry)))
    seen = pieces.join(_probe(pieces, faces, x, y), ["h", "k", "pid"], "left")
    return seen.filter("coalesce(in_a, false) AND NOT coalesce(in_b, false)").select("k", F.expr(
        "CASE WHEN side = 'a' THEN e ELSE named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1) END"
    ).alias("e"))


def _by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The boundaries a row can hold, and the larger ones (None when there are none)."""
    edges = stored(edges.distinct())
    sizes = edges.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.filter(F.col("n") > ROW_EDGES).select("k"))
    if large.isEmpty():
        return edges, None
    return edges.join(large, "k", "left_anti"), edges.join(large, "k", "left_semi")


def _row_rings(edges: DataFrame) -> DataFrame:
    return edges.groupBy("k").agg(F.collect_list("e").alias("edges")).select(
        "k", polygons_from_edges("edges").alias("parts"),
    )


def rings(edges: DataFrame) -> DataFrame:
    """(`k`, `parts`) from directed boundary edges (`k`, `e`)."""
    small, large = _by_size(edges)
    result = _row_rings(small)
    if large is None:
        return result
    found = []
    for turn in range(TILE_ROUNDS):
        parts, large = _tiled(large, turn)
        found.append(parts)
        if large.isEmpty():
            break
    # what lies across the tiles of all rounds
    small, large = _by_size(large)
    found.append(_row_rings(small).select("k", F.explode("parts").alias("part")))
    if large is not None:
        found.append(assembled(closed_rings(large)).select("k", F.explode("parts").alias("part")))
    every = reduce(DataFrame.unionByName, found)
    return result.unionByName(every.groupBy("k").agg(F.collect_list("part").alias("parts")))


@F.arrow_udf(T.StructType([T.StructField("parts", T.ArrayType(geo.PART_TYPE)), T.StructField("rest", EDGES_TYPE)]))
def _closed_in_tile(edges: pa.Array, tile: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(kernels.polygons_in_tiles(edges, tile), ["parts", "rest"])


_closed_in_tile = _closed_in_tile.asNondeterministic()


def _tiled(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Boundary edges (`k`, `e`, stored) as the polygons (`k`, `part`) that lie in a tile of the map
    each, and the edges that bound none of them. A crowded tile's edges are among these."""
    sizes = edges.groupBy("k").agg(
        F.expr("max(e.x1) - min(e.x1)").alias("w"), F.expr("max(e.y1) - min(e.y1)").alias("h"), F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.select("k", F.expr(f"sqrt(w * h / ceil(n / {TILE_EDGES}))").alias("size"), "n"))
    total, groups = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    place = lambda n: "named_struct({})".format(", ".join(
        f"'{a}', CAST(floor(e.{a}{n} / size + {kernels.SHIFT!r}D * {turn}) AS BIGINT)" for a in "xy"))
    # at both ends of an edge
    dealt = edges.join(_small(sizes.filter("size > 0").drop("n"), groups), "k").withColumn("tile", F.explode(F.expr(f"array_distinct(array({place(1)}, {place(2)}))")))
    crowded = stored(dealt.groupBy("k", "tile").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROW_EDGES).drop("n"))
    left = []
    if not crowded.isEmpty():
        left.append(dealt.filter(F.expr(f"tile = {place(1)}")).join(crowded, ["k", "tile"], "left_semi").select("k", "e"))
        dealt = dealt.join(crowded, ["k", "tile"], "left_anti")
    tiles = spread(dealt, (total or 0) // 10, "k", "tile").groupBy("k", "tile").agg(F.first("size").alias("size"), F.collect_list("e").alias("edges"))
    done = stored(tiles.select("k", _closed_in_tile("edges", F.struct("tile.x", "tile.y", "size", F.lit(turn).alias("turn"))).alias("found")))
    rest = reduce(DataFrame.unionByName, left, done.select("k", F.explode("found.rest").alias("e")))
    return done.select("k", F.explode("found.parts").alias("part")), rest


def hole_rings(edges: DataFrame) -> DataFrame:
    """(`k`, `ring`): the holes in the areas bounded by directed edges (`k`, `e`)."""
    small, large = _by_size(edges)
    holes = _row_rings(small).select("k", F.explode("parts").alias("p")).select("k", F.explode(F.expr("slice(p.rings, 2, size(p.rings))")).alias("ring"))
    return holes if large is None else holes.unionByName(closed_rings(large).filter("size < 0").select("k", "ring"))


@F.arrow_udf(geo.GEOMETRY_TYPE)
def _mended(geom: pa.Array) -> pa.Array:
    """NULL for what is valid or no polygon."""
    out = []
    for parts, kind in zip(planar.mended(geom.field("parts")), geom.field("kind").to_pylist()):
        if parts is not None:
            kind = "MULTIPOLYGON" if len(parts) > 1 else "POLYGON" if parts else kind
        out.append(None if parts is None else {"kind": kind, "parts": parts})
    return pa.array(out, GEOMETRY_ARROW)


def repaired(df: DataFrame) -> DataFrame:
    """`df` with its invalid polygons redone by the even-odd rule. A column of the scan: nothing
    is read before the rows are, and nothing is stored."""
    polygon = F.when(F.expr(geo.is_polygon("geom")), F.col("geom"))
    return df.withColumn("geom", F.coalesce(_mended(polygon), F.col("geom")))
