"""Steps on areas: clip, erase, overlay, dissolve, buffer, slivers, coverages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import noding
from .aggregates import Aggregate, aggregate_column
from .grid import geometry_id, overlapping_pairs, shapes, stored
from .joins import ROW, _matching, free_names
from .overlay import ROW_FACES, bounded, difference_parts, face, hole_rings, intersections, precision_grid, spread, union_edges, union_parts


def _geometry_pairs(base: DataFrame, source: DataFrame, predicate: str) -> DataFrame:
    """Matching distinct geometries: (`aid`, `a`, `bid`, `b`)."""
    left, right = shapes(base), shapes(source)
    pairs = overlapping_pairs(left, right)
    return pairs.filter(F.expr(geo.PREDICATES[predicate]("l.segs", "r.segs"))).select(
        F.col("l.id").alias("aid"), F.col("l.geom").alias("a"), F.col("r.id").alias("bid"), F.col("r.geom").alias("b"),
    )


def clip(base: DataFrame, source: DataFrame, predicate: str = "intersects") -> DataFrame:
    """Rows with `__matched`: true and the clipped geometry where the first matching mask
    leaves something of the row's own dimension, else false and the geometry as it was."""
    masks = stored(
        source.filter("size(geom.parts) > 0").select(geometry_id(F.col("geom")).alias("id"), "geom", ROW)
        .groupBy("id").agg(F.min(ROW).alias("row"), F.first("geom").alias("geom"))
        .select("id", "row", "geom", F.expr(geo.bbox("geom")).alias("box"), F.expr(geo.segments("geom")).alias("segs"))
    )
    left = shapes(base)
    first = stored(
        overlapping_pairs(left.select("id", "box", "segs"), masks.select("id", "row", "box", "segs"))
        .filter(F.expr(geo.PREDICATES[predicate]("l.segs", "r.segs")))
        .groupBy(F.col("l.id").alias("aid")).agg(F.min_by("r.id", F.col("r.row")).alias("bid"))
    )
    pairs = (
        first.join(left.select(F.col("id").alias("aid"), F.col("geom").alias("a")), "aid")
        .join(masks.select(F.col("id").alias("bid"), F.col("geom").alias("b")), "bid")
    )
    cut = intersections(spread(pairs, first.count())).filter("size(geom.parts) > 0").select(F.col("aid").alias("__gid"), F.col("geom").alias("__clipped"))
    joined = base.withColumn("__gid", geometry_id(F.col("geom"))).join(cut.hint("merge"), "__gid", "left")
    return joined.select(
        *[F.coalesce("__clipped", "geom").alias("geom") if c == "geom" else F.col(geo.quote(c)) for c in base.columns],
        F.col("__clipped").isNotNull().alias("__matched"),
    )


def intersect_overlay(base: DataFrame, source: DataFrame, fields: dict[str, str]) -> DataFrame:
    names = free_names(base, fields)
    cut = (
        intersections(_geometry_pairs(base, source, "intersects")).filter("size(geom.parts) > 0")
        .select(F.col("aid").alias("__gid"), F.col("bid").alias("__sid"), F.col("geom").alias("__cut"))
    )
    pulled = source.filter("size(geom.parts) > 0").select(
        geometry_id(F.col("geom")).alias("__sid"), F.col(ROW).alias("__b_row"),
        *[F.col(col).alias(f"__f_{i}") for i, col in enumerate(fields.values())],
    )
    joined = base.withColumn("__gid", geometry_id(F.col("geom"))).join(cut, "__gid").join(pulled, "__sid")
    new = {"geom": F.col("__cut"), ROW: F.concat(ROW, "__b_row")}
    return joined.select(
        *[new[c].alias(c) if c in new else F.col(geo.quote(c)) for c in base.columns],
        *[F.col(f"__f_{i}").alias(names[out]) for i, out in enumerate(fields)],
    )


def erase(base: DataFrame, source: DataFrame, predicate: str = "intersects") -> DataFrame:
    """Each row minus everything it matches; fully erased rows are dropped, as are rows
    without geometry."""
    left, right = shapes(base), shapes(source)
    pairs = stored(
        overlapping_pairs(left.select("id", "box", "segs"), right.select("id", "box", "segs"))
        .filter(F.expr(geo.PREDICATES[predicate]("l.segs", "r.segs")))
        .select(F.col("l.id").alias("k"), F.col("r.id").alias("bid"))
    )
    touched = pairs.select("k").distinct()
    a_rows = touched.join(left.select(F.col("id").alias("k"), "geom"), "k")
    b_rows = pairs.join(right.select(F.col("id").alias("bid"), "geom"), "bid").select("k", "geom")
    results = []
    dims = {r.d for r in a_rows.select(F.expr(geo.dimension("geom")).alias("d")).distinct().collect()}
    if 2 in dims:
        polys = a_rows.filter(F.expr(f"{geo.dimension('geom')} = 2"))
        both = polys.withColumn("side", F.lit("a")).unionByName(
            b_rows.join(polys.select("k"), "k", "left_semi").withColumn("side", F.lit("b")))
        results.append(difference_parts(both))
    if dims - {2}:
        results.append(_thin_difference(a_rows, b_rows))
    left_over = None
    for r in results:
        left_over = r if left_over is None else left_over.unionByName(r)
    keyed = base.filter("size(geom.parts) > 0").withColumn("__gid", geometry_id(F.col("geom")))
    if left_over is None:
        return keyed.select(*base.columns)
    joined = keyed.join(stored(touched).select(F.col("k").alias("__gid"), F.lit(True).alias("__hit")).hint("merge"), "__gid", "left").join(
        stored(left_over).select(F.col("k").alias("__gid"), "parts").hint("merge"), "__gid", "left",
    )
    return joined.filter("__hit IS NULL OR size(parts) > 0").withColumn(
        "geom", F.expr(f"CASE WHEN __hit THEN {geo.from_parts('parts')} ELSE geom END"),
    ).select(*base.columns)


def _thin_difference(a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """(`k`, `parts`) of lines and points minus whatever covers them."""
    thin = a_rows.filter(F.expr(f"{geo.dimension('geom')} < 2"))
    segs = thin.select("k", F.posexplode(F.expr(geo.segments("geom"))).alias("pos", "s"))
    eaters = stored(b_rows.join(thin.select("k"), "k", "left_semi").select(
        "k", F.expr(geo.segments("geom")).alias("segs"), F.expr(geo.bbox("geom")).alias("box"),
    ))
    boxed = stored(segs.withColumn("box", F.expr(
        "named_struct('xmin', least(s.x1, s.x2), 'ymin', least(s.y1, s.y2), 'xmax', greatest(s.x1, s.x2), 'ymax', greatest(s.y1, s.y2))"
    )))
    knives = stored(eaters.select("k", F.explode("segs").alias("s")).withColumn("box", F.expr(
        "named_struct('xmin', least(s.x1, s.x2), 'ymin', least(s.y1, s.y2), 'xmax', greatest(s.x1, s.x2), 'ymax', greatest(s.y1, s.y2))"
    )))
    marks = overlapping_pairs(boxed, knives, on=["k"]).select("l.k", "l.pos", F.expr(f"inline({noding.cuts('l.s', 'r.s')})"))
    ends = boxed.select("k", "pos", F.expr(
        "inline(array(named_struct('t', 0D, 'x', s.x1, 'y', s.y1), named_struct('t', 1D, 'x', s.x2, 'y', s.y2)))"))
    pieces = stored(
        marks.unionByName(ends).distinct()
        .withColumn("nx", F.expr("lead(x) OVER (PARTITION BY k, pos ORDER BY t, x, y)"))
        .withColumn("ny", F.expr("lead(y) OVER (PARTITION BY k, pos ORDER BY t, x, y)"))
        .join(boxed.select("k", "pos", F.col("s.d").alias("d")), ["k", "pos"])
        .filter("nx IS NOT NULL AND (d = 0 OR x <> nx OR y <> ny)")
        .withColumn("px", F.expr("(x + nx) / 2")).withColumn("py", F.expr("(y + ny) / 2"))
        .withColumn("box", F.expr("named_struct('xmin', px, 'ymin', py, 'xmax', px, 'ymax', py)"))
    )
    eaten = overlapping_pairs(pieces, eaters, on=["k"]).filter(
        F.expr(geo.covered("r.segs", "l.px", "l.py"))).select("l.k", "l.pos", "l.t").distinct()
    kept = pieces.join(eaten, ["k", "pos", "t"], "left_anti").groupBy("k").agg(F.expr(
        "array_sort(collect_list(named_struct('pos', pos, 't', t, 'd', d, 'x1', x, 'y1', y, 'x2', nx, 'y2', ny)))").alias("p"))
    dots = "transform(filter(p, e -> e.d = 0), e -> named_struct('dim', 0, 'rings', array(array(named_struct('x', e.x1, 'y', e.y1, 'z', CAST(NULL AS DOUBLE))))))"
    return kept.select("k", F.expr(f"concat({noding.runs('filter(p, e -> e.d = 1)')}, {dots})").alias("parts"))


# ---- dissolve ---------------------------------------------------------------

def union_geometry(rows: DataFrame) -> DataFrame:
    """(`k`, `geom`): the union of the geometries of each group `k`."""
    from .lines import union_line_parts

    flat = stored(rows.filter("size(geom.parts) > 0").select("k", "geom").distinct())
    kinds = {r.d for r in flat.select(F.explode(F.expr("transform(geom.parts, p -> p.dim)")).alias("d")).distinct().collect()}
    parts = []
    if 2 in kinds:
        polys = flat.withColumn("geom", F.expr(geo.from_parts("filter(geom.parts, p -> p.dim = 2)"))).filter("size(geom.parts) > 0")
        parts.append(union_parts(polys))
    if 1 in kinds:
        parts.append(union_line_parts(flat))
    if 0 in kinds:
        dots = flat.select("k", F.explode("geom.parts").alias("p")).filter("p.dim = 0").distinct()
        parts.append(dots.groupBy("k").agg(F.sort_array(F.collect_list("p")).alias("parts")))
    if not parts:
        return flat
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    if len(parts) > 1:
        result = result.groupBy("k").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return stored(result).select("k", F.expr(geo.from_parts("parts")).alias("geom"))


def group_keys(by: list) -> tuple[list[str], list]:
    """Names and columns of group keys: column names or (name, SQL)."""
    names = [k if isinstance(k, str) else k[0] for k in by]
    cols = [F.col(geo.quote(k)) if isinstance(k, str) else F.expr(k[1]) for k in by]
    return names, cols


def dissolve(df: DataFrame, by: list, aggregates: list[Aggregate]) -> DataFrame:
    """One row per group: its keys, its union, its aggregates; numbered by first member."""
    names, cols = group_keys(by)
    key_ids = [f"__k{i}" for i in range(len(names))]
    keyed = df.select("*", *[c.alias(i) for c, i in zip(cols, key_ids)])
    # the rows' keys as one struct: never NULL itself, and equal where its NULLs are
    keyed = keyed.withColumn("__k", F.struct(*key_ids) if key_ids else F.struct(F.lit(0).alias("one")))
    shape = union_geometry(keyed.select(F.col("__k").alias("k"), "geom")).select("k", F.col("geom").alias("__union"))
    aggs = [aggregate_column(a).alias(f"__a{i}") for i, a in enumerate(aggregates)]
    groups = keyed.groupBy("__k").agg(F.min(ROW).alias(ROW), *aggs)
    joined = groups.join(shape, F.col("__k") == F.col("k"), "left")
    return joined.select(
        *[F.col(f"__k.{i}").alias(n) for i, n in zip(key_ids, names)], F.col("__union").alias("geom"),
        *[F.col(f"__a{i}").alias(a.to) for i, a in enumerate(aggregates)], ROW,
    )


# ---- buffer -----------------------------------------------------------------

# Edges of the outline around a segment (`_capsule`).
CAPSULE_EDGES = 34


def buffer(df: DataFrame, distance: float, key: str = ROW) -> DataFrame:
    """Points become 32-gons; other shapes their union with a capsule around every segment,
    or, with a negative distance, polygons lose the capsules along their edges."""
    r = f"{abs(float(distance))!r}D"
    circle = geo.circle("geom.parts[0].rings[0][0].x", "geom.parts[0].rings[0][0].y", r)
    empty = geo._geometry("'POLYGON'", "array()")
    if distance == 0:
        return df.withColumn("geom", F.expr(f"CASE WHEN {geo.is_polygon('geom')} OR geom IS NULL THEN geom ELSE {empty} END"))
    single = "geom.kind = 'POINT' AND size(geom.parts) = 1"
    around = f"CASE WHEN size(geom.parts) = 0 THEN {empty} WHEN {single} THEN {circle if distance > 0 else empty} ELSE geom END"
    pending = f"(size(geom.parts) > 0 AND NOT ({single}) AND ({'true' if distance > 0 else geo.is_polygon('geom')}))"
    others = [c for c in df.columns if c != "geom"]
    # Each geometry once, with the row having it where that is the only one: such a row is grown
    # where it lies, and nothing of it is joined or written again. Some types can't be stored.
    told = not any(t in df.schema[c].dataType.simpleString() for c in others for t in ("void", "interval"))
    row = F.struct(*[F.col(geo.quote(c)).alias(f"c{i}") for i, c in enumerate(others)]) if told and others else F.lit(None).cast("struct<c0: int>")
    own = F.col("few") & ((F.col("n") == 1) if told and others else F.lit(False))
    once = df.filter(F.expr(pending)).select(geometry_id(F.col("geom")).alias("k"), "geom", row.alias("row")).groupBy("k").agg(
        F.first("geom").alias("geom"), F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    few = f"size({geo.segments('geom')}) <= {ROW_FACES // CAPSULE_EDGES}"
    once = stored(once.select("k", "geom", F.when(F.col("n") == 1, F.col("row")).alias("row"), "n", F.expr(few).alias("few"))).withColumn("own", own)
    boxes = once.select("few", "own", F.expr(geo.bbox("geom")).alias("box"))
    total, held_few, held_own = boxes.agg(F.count(F.lit(1)), F.count_if("few"), F.count_if("own")).first()
    if not total:
        thin = f"CASE WHEN geom IS NULL THEN NULL ELSE {around} END" if distance > 0 else (
            f"CASE WHEN geom IS NULL THEN NULL WHEN NOT {geo.is_polygon('geom')} THEN {empty} ELSE geom END")
        return df.withColumn("geom", F.expr(thin))
    # a shape of few segments holds its capsules itself; those of the others are rows
    # (merged and spread: what is stored is far smaller than its rows and the work on them)
    side, s = "'a'" if distance > 0 else "'b'", geo.var("s")
    capsules = f"transform({geo.segments('geom')}, {s} -> {face(side, f'({_capsule(s, r)}).parts')})"
    whole = face("'a'", "geom.parts")
    faces = f"CASE WHEN {geo.is_polygon('geom')} THEN concat({capsules}, array({whole})) ELSE {capsules} END"
    held = spread(once.filter("few"), held_few).select("k", "own", "row", F.expr(faces).alias("faces"))
    parts = bounded(held, precision_grid(boxes, abs(float(distance))), subtract=distance < 0)
    grown_shape = stored(parts.select("k", "own", "row", F.expr(f"CASE WHEN size(parts) > 0 THEN {geo.from_parts('parts')} ELSE {empty} END").alias("geom")))
    unpacked = [F.col("geom") if c == "geom" else F.col(f"row.c{others.index(c)}").alias(c) for c in df.columns]
    # points, and what has no geometry or comes to nothing
    plain = f"CASE WHEN geom IS NULL THEN NULL WHEN size(geom.parts) = 0 OR {'false' if distance > 0 else 'true'} THEN {empty} ELSE {around} END"
    result = df.filter(f"NOT coalesce({pending}, false)").withColumn("geom", F.expr(plain)).select(*df.columns)
    if held_own:
        result = result.unionByName(grown_shape.filter("own").select(*unpacked))
    if held_own < total:
        found = grown_shape.filter("NOT own").select("k", "geom")
        if held_few < total:
            rest = once.filter("NOT few").select("k", "geom", F.expr(geo.segments("geom")).alias("segs"))
            hulls = rest.select("k", F.explode("segs").alias("s")).select("k", F.expr(_capsule("s", r)).alias("geom")).distinct()
            if distance > 0:
                solid = rest.filter(F.expr(geo.is_polygon("geom"))).select("k", "geom")
                large = union_geometry(hulls.unionByName(solid))
            else:
                both = rest.select("k", "geom", F.lit("a").alias("side")).unionByName(hulls.withColumn("side", F.lit("b")))
                large = difference_parts(both).select("k", F.expr(geo.from_parts("parts")).alias("geom"))
            found = found.unionByName(stored(large))
        keyed = df.filter(F.expr(pending)).select(*[F.col(geo.quote(c)) for c in others], geometry_id(F.col("geom")).alias("__gid"))
        shared = once.filter("NOT own").select(F.col("k").alias("__gid")).join(
            found.select(F.col("k").alias("__gid"), "geom").hint("merge"), "__gid", "left")
        joined = keyed.join(shared.hint("merge"), "__gid").withColumn("geom", F.expr(f"coalesce(geom, {empty})"))
        result = result.unionByName(joined.select(*df.columns))
    return result


def _capsule(s: str, r: str) -> str:
    """A segment with round ends: two half circles of 16 steps (a circle for a point)."""
    i, a = geo.var("i"), geo.var("a")
    ring = (
        f"transform(array(CASE WHEN {s}.x1 = {s}.x2 AND {s}.y1 = {s}.y2 THEN 0D ELSE atan2({s}.y2 - {s}.y1, {s}.x2 - {s}.x1) END), {a} -> "
        f"transform(sequence(0, 33), {i} -> CASE WHEN {i} <= 16 THEN "
        + geo.vertex(f"{s}.x2 + {r} * cos({a} - pi() / 2 + pi() * {i} / 16)", f"{s}.y2 + {r} * sin({a} - pi() / 2 + pi() * {i} / 16)")
        + " ELSE "
        + geo.vertex(f"{s}.x1 + {r} * cos({a} + pi() / 2 + pi() * ({i} - 17) / 16)", f"{s}.y1 + {r} * sin({a} + pi() / 2 + pi() * ({i} - 17) / 16)")
        + " END))[0]"
    )
    q = geo.var("q")
    return f"transform(array({ring}), {q} -> {geo.polygon(f'array(concat({q}, array({q}[0])))')})[0]"


# ---- neighbours -------------------------------------------------------------

def border_lengths(pairs: DataFrame) -> DataFrame:
    """`pairs` (polygon segment arrays `a`, `b`) plus `border`: the length they share."""
    s, e, t = geo.var("s"), geo.var("e"), geo.var("t")
    size = f"sqrt(pow({s}.x2 - {s}.x1, 2) + pow({s}.y2 - {s}.y1, 2))"
    along = lambda i: (
        f"try_divide(({e}.x{i} - {s}.x1) * ({s}.x2 - {s}.x1) + ({e}.y{i} - {s}.y1) * ({s}.y2 - {s}.y1), {size})"
    )
    off = lambda i: f"abs({geo._edge_cross(s, f'{e}.x{i}', f'{e}.y{i}')}) <= 1e-9 * {size}"
    shared = (
        f"CASE WHEN {size} > 0 AND {off(1)} AND {off(2)} THEN greatest(0D, least({size}, greatest({along(1)}, {along(2)})) "
        f"- greatest(0D, least({along(1)}, {along(2)}))) ELSE 0D END"
    )
    total = (
        f"aggregate(a, 0D, ({t}, {s}) -> {t} + aggregate(b, 0D, (u, {e}) -> u + {shared}))"
    )
    return pairs.withColumn("border", F.expr(total))


def eliminate_slivers(
    df: DataFrame, max_area: float | None = None, where: str | None = None, merge_into: str = "longest_border",
) -> DataFrame:
    picks = [geo.is_polygon("geom")]
    if max_area is not None:
        picks.append(f"{geo.area('geom')} < {float(max_area)!r}D")
    if where:
        picks.append(f"({where})")
    rows = stored(df.withColumn("__sliver", F.expr(f"coalesce({' AND '.join(picks)}, false)")))
    prepared = stored(rows.filter(F.expr(geo.is_polygon("geom")) & F.expr("size(geom.parts) > 0")).select(
        F.col(ROW).alias("row"), "__sliver", F.expr(geo.bbox("geom")).alias("box"),
        F.expr(geo.segments("geom")).alias("segs"), F.expr(geo.area("geom")).alias("area"),
    ))
    pairs = overlapping_pairs(
        prepared.filter("__sliver").drop("__sliver"), prepared.filter("NOT __sliver").drop("__sliver"),
    ).select(F.col("l.row").alias("s"), F.col("r.row").alias("b"), F.col("l.segs").alias("a"), F.col("r.segs").alias("c"), F.col("r.area").alias("area"))
    touching = border_lengths(pairs.withColumnRenamed("b", "t").withColumnRenamed("c", "b")).filter("border > 0")
    score = F.col("border") if merge_into == "longest_border" else F.col("area")
    target = stored(touching.groupBy("s").agg(F.min_by("t", F.struct(-score, "t")).alias("t")))
    eaten = target.join(rows.select(F.col(ROW).alias("s"), "geom"), "s").select(F.col("t").alias("k"), "geom")
    takers = rows.join(target.select(F.col("t").alias(ROW)).distinct(), ROW, "left_semi").select(F.col(ROW).alias("k"), "geom")
    grown_shape = union_geometry(eaten.unionByName(takers)).select(F.col("k").alias(ROW), F.col("geom").alias("__grown"))
    return (
        rows.join(target.select(F.col("s").alias(ROW)), ROW, "left_anti").join(grown_shape.hint("merge"), ROW, "left")
        .withColumn("geom", F.coalesce("__grown", "geom")).select(*df.columns)
    )


# ---- coverages --------------------------------------------------------------

# Without a snap distance: this fraction of the coverage's larger side.
DEFAULT_SNAP = 1e-8


def clean_coverage(df: DataFrame, snap_distance: float | None = None, max_gap_width: float | None = None) -> DataFrame:
    """Near vertices snapped together, overlaps left to the earliest row, narrow gaps given to
    the neighbour with the longest border along them."""
    rows = stored(df)
    polys = stored(rows.filter(F.expr(geo.is_polygon("geom")) & F.expr("size(geom.parts) > 0")).select(F.col(ROW).alias("row"), "geom"))
    extent = polys.select(F.expr(geo.bbox("geom")).alias("b")).agg(
        F.max("b.xmax") - F.min("b.xmin"), F.max("b.ymax") - F.min("b.ymin")).first()
    if extent[0] is None:
        return rows
    snap = snap_distance if snap_distance is not None else max(extent) * DEFAULT_SNAP
    fitted = stored(_snapped(polys, snap))
    cleared = stored(_without_overlaps(fitted))
    if max_gap_width is not None:
        cleared = stored(_gaps_filled(cleared, max_gap_width))
    result = cleared.select(F.col("row").alias(ROW), F.col("geom").alias("__new"))
    empty = geo._geometry("geom.kind", "array()")
    joined = rows.join(result.hint("merge"), ROW, "left")
    was_polygon = f"{geo.is_polygon('geom')} AND size(geom.parts) > 0"
    as_kind = f"CASE WHEN size(__new.parts) = 0 THEN {empty} WHEN geom.kind = 'MULTIPOLYGON' THEN {geo._geometry(repr('MULTIPOLYGON'), '__new.parts')} ELSE __new END"
    return joined.withColumn("geom", F.expr(f"CASE WHEN {was_polygon} THEN {as_kind} ELSE geom END")).select(*df.columns)


def _lowest_reached(near: DataFrame) -> DataFrame:
    """Of each vertex `v` the lowest one reached over any number of near pairs (`v`, `w`). Each
    round takes the lowest among a vertex and its neighbours, and what that one has reached."""
    found = stored(near.groupBy("v").agg(F.min("w").alias("to")))
    while True:
        seen = near.join(found.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("to").alias("to"))
        further = found.select(F.col("v").alias("to"), F.col("to").alias("next"))
        moved = stored(seen.join(further, "to").select("v", F.col("next").alias("to")))
        if moved.join(found.withColumnRenamed("to", "was"), "v").filter("to <> was").isEmpty():
            return moved
        found = moved


def _snapped(polys: DataFrame, snap: float) -> DataFrame:
    """Vertices that are within `snap` of each other, directly or over others, moved to the
    lowest of them, then edges bent through the vertices lying within `snap` of them."""
    verts = polys.select(F.explode(F.expr(geo.vertices("geom"))).alias("v")).select("v.x", "v.y").distinct()
    boxed = stored(verts.withColumn("box", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))))
    wide = boxed.withColumn("box", F.expr(f"named_struct('xmin', x - {snap!r}D, 'ymin', y - {snap!r}D, 'xmax', x + {snap!r}D, 'ymax', y + {snap!r}D)"))
    near = overlapping_pairs(wide, boxed).filter(f"pow(l.x - r.x, 2) + pow(l.y - r.y, 2) <= {snap * snap!r}D AND NOT (l.x = r.x AND l.y = r.y)")
    near = stored(near.select(F.struct("l.x", "l.y").alias("v"), F.struct("r.x", "r.y").alias("w")))
    # points with the next one of their ring; what isn't finite is near nothing, itself included
    n = geo.var("n")
    finite = f"filter(ring, {n} -> abs({n}.x) < double('Infinity') AND abs({n}.y) < double('Infinity'))"
    ahead = f"transform({finite}, {n} -> named_struct('x', {n}.x + 0D, 'y', {n}.y + 0D))"
    rings = polys.select("row", F.posexplode("geom.parts").alias("p", "part")).select(
        "row", "p", F.posexplode("part.rings").alias("q", "ring")).select("row", "p", "q", F.expr(ahead).alias("v"))
    points = rings.select("row", "p", "q", F.posexplode(F.expr(
        "transform(v, (a, i) -> named_struct('x', a.x, 'y', a.y, 'nx', get(v, i + 1).x, 'ny', get(v, i + 1).y))")).alias("i", "e")).select("row", "p", "q", "i", "e.*")
    if not near.isEmpty():  # only vertices that have others near them can move
        moves = stored(_lowest_reached(stored(near.unionByName(near.select("v", F.col("v").alias("w")).distinct()))))
        for x, y in (("x", "y"), ("nx", "ny")):
            to = moves.select(F.col("v.x").alias(x), F.col("v.y").alias(y), "to")
            points = points.join(to.hint("merge"), [x, y], "left").withColumn(x, F.coalesce("to.x", x)).withColumn(y, F.coalesce("to.y", y)).drop("to")
    moved = stored(points.select("row", "p", "q", "i", "x", "y", "nx", "ny"))
    # an edge passing within `snap` of a vertex gets it
    edge_boxes = moved.filter("nx IS NOT NULL").withColumn("box", F.expr(
        f"named_struct('xmin', least(x, nx) - {snap!r}D, 'ymin', least(y, ny) - {snap!r}D, 'xmax', greatest(x, nx) + {snap!r}D, 'ymax', greatest(y, ny) + {snap!r}D)"))
    kept = stored(moved.select("x", "y").distinct().withColumn("box", F.struct(
        F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))))
    seg = "named_struct('x1', l.x, 'y1', l.y, 'x2', l.nx, 'y2', l.ny)"
    t = "try_divide((r.x - l.x) * (l.nx - l.x) + (r.y - l.y) * (l.ny - l.y), pow(l.nx - l.x, 2) + pow(l.ny - l.y, 2))"
    bends = overlapping_pairs(edge_boxes, kept).withColumn("t", F.expr(t)).withColumn("s", F.expr(seg)).filter(
        f"t > 0 AND t < 1 AND NOT (r.x = l.x AND r.y = l.y) AND NOT (r.x = l.nx AND r.y = l.ny) AND "
        f"{geo.point_segment_distance2('r.x', 'r.y', 's')} <= {snap * snap!r}D"
    ).select("l.row", "l.p", "l.q", "l.i", "t", "r.x", "r.y")
    every = moved.select("row", "p", "q", "i", F.lit(0.0).alias("t"), "x", "y").unionByName(bends)
    ring = every.repartition("row").groupBy("row", "p", "q").agg(F.expr(
        "transform(array_sort(collect_list(named_struct('i', i, 't', t, 'x', x, 'y', y))), "
        "v -> named_struct('x', v.x, 'y', v.y, 'z', CAST(NULL AS DOUBLE)))").alias("ring"))
    clean = ring.withColumn("ring", F.expr(geo.drop_repeats("ring"))).filter(F.expr(f"{geo.ring_area2('ring')} <> 0"))
    parts = clean.groupBy("row", "p").agg(F.expr(
        "transform(array_sort(collect_list(named_struct('q', q, 'r', ring))), c -> c.r)").alias("rings"), F.min("q").alias("first")).filter("first = 0")
    return parts.groupBy("row").agg(F.expr(
        "transform(array_sort(collect_list(named_struct('p', p, 'rings', rings))), c -> named_struct('dim', 2, 'rings', c.rings))").alias("parts")
    ).select("row", F.expr(geo.from_parts("parts")).alias("geom"))


def _without_overlaps(polys: DataFrame) -> DataFrame:
    """Each polygon minus the earlier rows it overlaps; nothing left is an EMPTY one."""
    prepared = stored(polys.select("row", F.expr(geo.bbox("geom")).alias("box"), F.expr(geo.segments("geom")).alias("segs"), "geom"))
    lean = prepared.drop("geom")
    pairs = stored(overlapping_pairs(lean, lean).filter("r.row < l.row").filter(F.expr(geo.intersects("l.segs", "r.segs"))).select(
        F.col("l.row").alias("k"), F.col("r.row").alias("b")))
    if pairs.isEmpty():
        return polys
    a = pairs.select("k").distinct().join(polys.select(F.col("row").alias("k"), "geom"), "k").withColumn("side", F.lit("a"))
    b = pairs.join(polys.select(F.col("row").alias("b"), "geom"), "b").select("k", "geom", F.lit("b").alias("side"))
    left = stored(difference_parts(a.unionByName(b)))
    hit = pairs.select(F.col("k").alias("row"), F.lit(True).alias("hit")).distinct()
    empty = geo._geometry("'POLYGON'", "array()")
    return polys.join(hit.hint("merge"), "row", "left").join(left.select(F.col("k").alias("row"), "parts").hint("merge"), "row", "left").select("row", F.expr(
        f"CASE WHEN hit IS NULL THEN geom WHEN size(parts) > 0 THEN {geo.from_parts('parts')} ELSE {empty} END").alias("geom"))


def _gaps_filled(polys: DataFrame, width: float) -> DataFrame:
    """Holes of the whole coverage narrower than `width` joined to the neighbour that shares
    the longest border with them. A gap's width is the shorter side of its box or twice its
    area over half its perimeter, whichever is less."""
    solid = polys.filter("size(geom.parts) > 0")
    outline = union_edges(solid.select(F.lit(0).alias("k"), "geom"))
    holes = hole_rings(outline).select(F.expr(geo.polygon("array(reverse(ring))")).alias("geom"))
    narrow = (
        f"least(b.xmax - b.xmin, b.ymax - b.ymin, try_divide(4 * {geo.area('geom')}, {geo.perimeter('geom')})) < {float(width)!r}D"
    )
    gaps = stored(holes.withColumn("b", F.expr(geo.bbox("geom"))).filter(narrow).select(
        F.xxhash64("geom").alias("gap"), "geom", F.col("b").alias("box"), F.expr(geo.segments("geom")).alias("segs")))
    sides = stored(solid.select("row", F.expr(geo.bbox("geom")).alias("box"), F.expr(geo.segments("geom")).alias("segs")))
    pairs = overlapping_pairs(gaps.drop("geom"), sides).select("l.gap", "r.row", F.col("l.segs").alias("a"), F.col("r.segs").alias("b"))
    owner = stored(border_lengths(pairs).filter("border > 0").groupBy("gap").agg(
        F.min_by("row", F.struct(-F.col("border"), "row")).alias("row")))
    if owner.isEmpty():
        return polys
    add = owner.join(gaps.select("gap", "geom"), "gap").select(F.col("row").alias("k"), "geom")
    takers = polys.join(owner.select("row").distinct(), "row", "left_semi").select(F.col("row").alias("k"), "geom")
    filled = union_geometry(add.unionByName(takers)).select(F.col("k").alias("row"), F.col("geom").alias("__filled"))
    return polys.join(filled, "row", "left").select("row", F.coalesce("__filled", "geom").alias("geom"))
