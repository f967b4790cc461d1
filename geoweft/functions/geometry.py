"""Geometry as a nested column, and the Column-level functions over it.

A geometry is STRUCT<kind, parts ARRAY<STRUCT<dim, rings ARRAY<ARRAY<STRUCT<x, y, z>>>>>>:
one part per point, line or polygon (dim 0, 1, 2), a polygon's first ring its shell and the
others its holes. NULL is no geometry, an empty `parts` an EMPTY one.

The functions here take SQL text and return SQL text (to be used with `F.expr`), so they can
be nested inside each other's lambdas and are planned by Catalyst as plain expressions.
"""
from __future__ import annotations

import itertools

from pyspark.sql import types as T

VERTEX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z")])
RING_TYPE = T.ArrayType(VERTEX_TYPE)
PART_TYPE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("rings", T.ArrayType(RING_TYPE))])
GEOMETRY_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(PART_TYPE))])

VERTEX = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
RING = f"ARRAY<{VERTEX}>"
PART = f"STRUCT<dim: INT, rings: ARRAY<{RING}>>"
GEOMETRY = f"STRUCT<kind: STRING, parts: ARRAY<{PART}>>"
SEGMENT = "STRUCT<d: INT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

_counter = itertools.count()


def var(prefix: str) -> str:
    """A lambda variable name used nowhere else."""
    return f"{prefix}_{next(_counter)}"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---- constructors -----------------------------------------------------------

def vertex(x: str, y: str, z: str = "CAST(NULL AS DOUBLE)") -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'z', {z})"


def _geometry(kind: str, parts: str) -> str:
    return f"named_struct('kind', {kind}, 'parts', CAST({parts} AS ARRAY<{PART}>))"


def point(x: str, y: str) -> str:
    """NULL when either coordinate is."""
    made = _geometry("'POINT'", f"array(named_struct('dim', 0, 'rings', array(array({vertex(x, y)}))))")
    return f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN {made} END"


def line(ring: str) -> str:
    return _geometry("'LINESTRING'", f"array(named_struct('dim', 1, 'rings', array({ring})))")


def polygon(rings: str) -> str:
    return _geometry("'POLYGON'", f"array(named_struct('dim', 2, 'rings', {rings}))")


def box(x0: str, y0: str, x1: str, y1: str) -> str:
    ring = ", ".join(vertex(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
    return polygon(f"array(array({ring}))")


def segment(x1: str, y1: str, x2: str, y2: str) -> str:
    return line(f"array({vertex(x1, y1)}, {vertex(x2, y2)})")


def from_parts(parts: str, multi: str = "false") -> str:
    """The geometry of `parts`: single kind for one part, MULTI… for several of one
    dimension, GEOMETRYCOLLECTION otherwise. `multi` forces the MULTI kind."""
    d, p = var("d"), var("p")
    dims = f"array_distinct(transform({parts}, {p} -> {p}.dim))"
    kind = (
        f"transform(array({dims}), {d} -> CASE WHEN size({d}) <> 1 THEN 'GEOMETRYCOLLECTION' ELSE "
        f"concat(CASE WHEN size({parts}) > 1 OR {multi} THEN 'MULTI' ELSE '' END, "
        f"element_at(array('POINT', 'LINESTRING', 'POLYGON'), {d}[0] + 1)) END)[0]"
    )
    return _geometry(kind, parts)


# ---- walking ----------------------------------------------------------------

def dimension(g: str) -> str:
    p = var("p")
    return f"array_max(transform(({g}).parts, {p} -> {p}.dim))"


def is_empty(g: str) -> str:
    return f"(size(({g}).parts) = 0)"


def is_polygon(g: str) -> str:
    return f"(({g}).kind IN ('POLYGON', 'MULTIPOLYGON'))"


def is_line(g: str) -> str:
    return f"(({g}).kind IN ('LINESTRING', 'MULTILINESTRING'))"


def vertices(g: str) -> str:
    p = var("p")
    return f"flatten(transform(({g}).parts, {p} -> flatten({p}.rings)))"


def map_rings(g: str, fn) -> str:
    """The geometry with every ring `r` replaced by `fn(r, part)`."""
    p, r = var("p"), var("r")
    parts = (
        f"transform(({g}).parts, {p} -> named_struct('dim', {p}.dim, 'rings', "
        f"transform({p}.rings, {r} -> {fn(r, p)})))"
    )
    return f"CASE WHEN ({g}) IS NOT NULL THEN {_geometry(f'({g}).kind', parts)} END"


def map_vertices(g: str, fn) -> str:
    v = var("v")
    return map_rings(g, lambda r, _p: f"transform({r}, {v} -> {fn(v)})")


def ring_segments(r: str, dim: str) -> str:
    """A ring's (or line's) segments; a lone vertex is one of length zero."""
    i = var("i")
    seg = (
        f"named_struct('d', {dim}, 'x1', {r}[{i}].x, 'y1', {r}[{i}].y, "
        f"'x2', {r}[{i} + 1].x, 'y2', {r}[{i} + 1].y)"
    )
    dot = f"named_struct('d', {dim}, 'x1', {r}[0].x, 'y1', {r}[0].y, 'x2', {r}[0].x, 'y2', {r}[0].y)"
    return (
        f"CASE WHEN size({r}) > 1 THEN transform(sequence(0, size({r}) - 2), {i} -> {seg}) "
        f"WHEN size({r}) = 1 THEN array({dot}) ELSE CAST(array() AS ARRAY<{SEGMENT}>) END"
    )


def segments(g: str) -> str:
    """All segments of a geometry, flat: the shape the predicates below work on."""
    p, r = var("p"), var("r")
    return (
        f"flatten(transform(({g}).parts, {p} -> flatten(transform({p}.rings, "
        f"{r} -> {ring_segments(r, p + '.dim')}))))"
    )


def bbox(g: str) -> str:
    """STRUCT<xmin, ymin, xmax, ymax>, NULL for no or an empty geometry."""
    v, a, b, c, d = (var(n) for n in "vabcd")
    vs = vertices(g)
    return (
        f"CASE WHEN size(({g}).parts) > 0 THEN named_struct("
        f"'xmin', array_min(transform({vs}, {a} -> {a}.x)), 'ymin', array_min(transform({vs}, {b} -> {b}.y)), "
        f"'xmax', array_max(transform({vs}, {c} -> {c}.x)), 'ymax', array_max(transform({vs}, {d} -> {d}.y))) END"
    )


# ---- measures ---------------------------------------------------------------

def ring_area2(r: str) -> str:
    """Twice a ring's signed area (positive counter-clockwise), relative to its first vertex."""
    s, i = var("s"), var("i")
    return (
        f"CASE WHEN size({r}) < 4 THEN 0D ELSE aggregate(sequence(1, size({r}) - 2), 0D, ({s}, {i}) -> {s} + "
        f"(({r}[{i}].x - {r}[0].x) * ({r}[{i} + 1].y - {r}[0].y) - "
        f"({r}[{i} + 1].x - {r}[0].x) * ({r}[{i}].y - {r}[0].y))) END"
    )


def ring_length(r: str) -> str:
    s, i = var("s"), var("i")
    return (
        f"CASE WHEN size({r}) < 2 THEN 0D ELSE aggregate(sequence(0, size({r}) - 2), 0D, ({s}, {i}) -> {s} + "
        f"sqrt(pow({r}[{i} + 1].x - {r}[{i}].x, 2) + pow({r}[{i} + 1].y - {r}[{i}].y, 2))) END"
    )


def part_area(p: str) -> str:
    s, r = var("s"), var("r")
    first = f"abs({ring_area2(p + '.rings[0]')})"
    return (
        f"CASE WHEN {p}.dim = 2 THEN (2 * {first} - aggregate({p}.rings, 0D, "
        f"({s}, {r}) -> {s} + abs({ring_area2(r)}))) / 2 ELSE 0D END"
    )


def area(g: str) -> str:
    s, p = var("s"), var("p")
    return f"aggregate(({g}).parts, 0D, ({s}, {p}) -> {s} + {part_area(p)})"


def _ring_lengths(g: str, dim: int) -> str:
    s, p, t, r = var("s"), var("p"), var("t"), var("r")
    return (
        f"aggregate(({g}).parts, 0D, ({s}, {p}) -> CASE WHEN {p}.dim = {dim} THEN "
        f"{s} + aggregate({p}.rings, 0D, ({t}, {r}) -> {t} + {ring_length(r)}) ELSE {s} END)"
    )


def length(g: str) -> str:
    return _ring_lengths(g, 1)


def perimeter(g: str) -> str:
    return _ring_lengths(g, 2)


def npoints(g: str) -> str:
    return f"size({vertices(g)})"


def centroid(g: str) -> str:
    """Weighted by area, length or count, over the parts of the highest dimension."""
    m, p, w, r, s, e, o = (var(n) for n in ("m", "p", "w", "r", "s", "e", "o"))
    # one (weight, x·weight, y·weight) triple per ring, relative to the geometry's first vertex
    def moments(ring: str, dim: str) -> str:
        cross = (
            f"(({e}.x1 - {o}.x) * ({e}.y2 - {o}.y) - ({e}.x2 - {o}.x) * ({e}.y1 - {o}.y))"
        )
        weight = (
            f"CASE {dim} WHEN 2 THEN {cross} / 2 "
            f"WHEN 1 THEN sqrt(pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2)) ELSE 1D END"
        )
        cx = (
            f"CASE {dim} WHEN 2 THEN ({e}.x1 + {e}.x2 - 2 * {o}.x) / 3 "
            f"ELSE ({e}.x1 + {e}.x2) / 2 - {o}.x END"
        )
        cy = cx.replace(".x", ".y")
        return (
            f"aggregate({ring_segments(ring, dim)}, named_struct('w', 0D, 'x', 0D, 'y', 0D), ({s}, {e}) -> "
            f"named_struct('w', {s}.w + {weight}, 'x', {s}.x + ({weight}) * ({cx}), 'y', {s}.y + ({weight}) * ({cy})))"
        )
    k = var("k")
    # a shell counts positive and a hole negative, whichever way they run
    def signed(t: str, idx: str) -> str:
        f = f"CASE WHEN {p}.dim < 2 OR (({t}.w > 0) = ({idx} = 0)) THEN 1D ELSE -1D END"
        return f"named_struct('w', {t}.w * {f}, 'x', {t}.x * {f}, 'y', {t}.y * {f})"
    t = var("t")
    per_ring = (
        f"flatten(transform(filter(({g}).parts, {p} -> {p}.dim = {m}), {p} -> transform({p}.rings, ({r}, {k}) -> "
        f"transform(array({moments(r, p + '.dim')}), {t} -> {signed(t, k)})[0])))"
    )
    q, u, z = var("q"), var("u"), var("z")
    total = (
        f"aggregate({per_ring}, named_struct('w', 0D, 'x', 0D, 'y', 0D), ({q}, {u}) -> "
        f"named_struct('w', {q}.w + {u}.w, 'x', {q}.x + {u}.x, 'y', {q}.y + {u}.y))"
    )
    first = f"({g}).parts[0].rings[0][0]"
    flat = f"{vertices(g)}"
    n, c = var("n"), var("c")
    mean = lambda axis: f"(aggregate({flat}, 0D, ({n}, {c}) -> {n} + {c}.{axis}) / size({flat}))"
    made = point(
        f"CASE WHEN {z}.w <> 0 THEN {o}.x + try_divide({z}.x, {z}.w) ELSE {mean('x')} END",
        f"CASE WHEN {z}.w <> 0 THEN {o}.y + try_divide({z}.y, {z}.w) ELSE {mean('y')} END",
    )
    return (
        f"CASE WHEN {is_empty(g)} THEN {_geometry(chr(39) + 'POINT' + chr(39), 'array()')} "
        f"WHEN ({g}) IS NOT NULL THEN transform(array({dimension(g)}), {m} -> transform(array({first}), {o} -> "
        f"transform(array({total}), {z} -> {made})[0])[0])[0] END"
    )


# ---- predicates over segment arrays -----------------------------------------

def _cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({px} - {ax}) * ({by} - {ay}))"


def _edge_cross(e: str, px: str, py: str) -> str:
    return _cross(f"{e}.x1", f"{e}.y1", f"{e}.x2", f"{e}.y2", px, py)


def on_segment(e: str, px: str, py: str) -> str:
    return (
        f"({py} >= least({e}.y1, {e}.y2) AND {py} <= greatest({e}.y1, {e}.y2) AND "
        f"{px} >= least({e}.x1, {e}.x2) AND {px} <= greatest({e}.x1, {e}.x2) AND "
        f"{_edge_cross(e, px, py)} = 0)"
    )


def location(segs: str, px: str, py: str) -> str:
    """0 outside, 1 inside, 2 on the edge of the polygons among `segs`."""
    a, e = var("a"), var("e")
    return (
        f"aggregate({segs}, 0, ({a}, {e}) -> CASE WHEN {a} = 2 OR {e}.d <> 2 THEN {a} "
        f"WHEN {px} > greatest({e}.x1, {e}.x2) OR {py} > greatest({e}.y1, {e}.y2) "
        f"OR {py} < least({e}.y1, {e}.y2) THEN {a} "
        f"WHEN {on_segment(e, px, py)} THEN 2 "
        f"WHEN ({e}.y1 > {py}) <> ({e}.y2 > {py}) AND "
        f"(({_edge_cross(e, px, py)} > 0) = ({e}.y2 > {e}.y1)) THEN 1 - {a} ELSE {a} END)"
    )


def covered(segs: str, px: str, py: str) -> str:
    """Whether the point lies in or on the geometry of `segs`."""
    e = var("e")
    return (
        f"({location(segs, px, py)} > 0 OR exists({segs}, {e} -> {e}.d < 2 AND {on_segment(e, px, py)}))"
    )


def segments_meet(a: str, b: str) -> str:
    def side(e, f):
        return (
            f"sign({_edge_cross(e, f + '.x1', f + '.y1')}) * sign({_edge_cross(e, f + '.x2', f + '.y2')}) <= 0"
        )
    return (
        f"(greatest({a}.x1, {a}.x2) >= least({b}.x1, {b}.x2) AND greatest({b}.x1, {b}.x2) >= least({a}.x1, {a}.x2) "
        f"AND greatest({a}.y1, {a}.y2) >= least({b}.y1, {b}.y2) AND greatest({b}.y1, {b}.y2) >= least({a}.y1, {a}.y2) "
        f"AND {side(a, b)} AND {side(b, a)})"
    )


def segments_cross(a: str, b: str) -> str:
    """Whether the two segments cross at a point inside both."""
    def side(e, f):
        return (
            f"sign({_edge_cross(e, f + '.x1', f + '.y1')}) * sign({_edge_cross(e, f + '.x2', f + '.y2')}) < 0"
        )
    return f"({side(a, b)} AND {side(b, a)})"


def intersects(a: str, b: str) -> str:
    """Of two segment arrays."""
    s, t, u, w = var("s"), var("t"), var("u"), var("w")
    return (
        f"(CASE WHEN size({a}) = 1 AND {a}[0].d = 0 THEN {covered(b, a + '[0].x1', a + '[0].y1')} "
        f"WHEN size({b}) = 1 AND {b}[0].d = 0 THEN {covered(a, b + '[0].x1', b + '[0].y1')} ELSE "
        f"exists({a}, {s} -> exists({b}, {t} -> {segments_meet(s, t)})) "
        f"OR exists({a}, {u} -> {location(b, u + '.x1', u + '.y1')} > 0) "
        f"OR exists({b}, {w} -> {location(a, w + '.x1', w + '.y1')} > 0) END)"
    )


def _inner_probe(segs: str) -> str:
    """A point just inside the polygon of `segs`, beside the middle of its first edge."""
    e, q, k = var("e"), var("q"), var("k")
    poly = f"filter({segs}, {e} -> {e}.d = 2)"
    def at(sign: int) -> str:
        return (
            f"named_struct('x', ({q}.x1 + {q}.x2) / 2 + {sign} * ({q}.y2 - {q}.y1) * 1e-6, "
            f"'y', ({q}.y1 + {q}.y2) / 2 - {sign} * ({q}.x2 - {q}.x1) * 1e-6)"
        )
    return (
        f"filter(transform({poly}, {q} -> transform(array(array({at(1)}, {at(-1)})), "
        f"{k} -> CASE WHEN {location(segs, f'{k}[0].x', f'{k}[0].y')} = 1 THEN {k}[0] ELSE {k}[1] END)[0]), "
        f"{e} -> {location(segs, e + '.x', e + '.y')} = 1)"
    )


def _middles(s: str, others: str) -> str:
    """Middles of the stretches of segment `s` between the ends of `others` lying on it."""
    e, t, i = var("e"), var("t"), var("i")
    def along(px: str, py: str) -> str:
        return (
            f"try_divide(({px} - {s}.x1) * ({s}.x2 - {s}.x1) + ({py} - {s}.y1) * ({s}.y2 - {s}.y1), "
            f"pow({s}.x2 - {s}.x1, 2) + pow({s}.y2 - {s}.y1, 2))"
        )
    cuts = (
        f"array_sort(array_distinct(concat(array(0D, 1D), transform(filter({others}, {e} -> "
        f"{on_segment(s, e + '.x1', e + '.y1')}), {e} -> coalesce({along(e + '.x1', e + '.y1')}, 0D)))))"
    )
    return (
        f"transform(array({cuts}), {t} -> transform(sequence(0, size({t}) - 2), {i} -> named_struct("
        f"'x', {s}.x1 + ({s}.x2 - {s}.x1) * ({t}[{i}] + {t}[{i} + 1]) / 2, "
        f"'y', {s}.y1 + ({s}.y2 - {s}.y1) * ({t}[{i}] + {t}[{i} + 1]) / 2)))[0]"
    )


def within(a: str, b: str) -> str:
    """`a` lies in `b` and their interiors meet (two segment arrays)."""
    s, t, m, n, e = var("s"), var("t"), var("m"), var("n"), var("e")
    dim = lambda g: f"{g}[0].d"
    inside = f"forall({a}, {s} -> {covered(b, s + '.x1', s + '.y1')} AND {covered(b, s + '.x2', s + '.y2')})"
    point_case = (
        f"(exists({a}, {s} -> CASE WHEN {dim(b)} = 2 THEN {location(b, s + '.x1', s + '.y1')} = 1 "
        f"WHEN {dim(b)} = 1 THEN aggregate({b}, 0, ({n}, {e}) -> {n} + "
        f"CAST({e}.x1 = {s}.x1 AND {e}.y1 = {s}.y1 AS INT) + CAST({e}.x2 = {s}.x1 AND {e}.y2 = {s}.y1 AS INT)) <> 1 "
        f"ELSE true END) AND {inside})"
    )
    mids = f"forall({a}, {s} -> forall({_middles(s, b)}, {m} -> {covered(b, m + '.x', m + '.y')}))"
    uncrossed = f"NOT exists({a}, {s} -> exists({b}, {t} -> {t}.d = 2 AND {segments_cross(s, t)}))"
    line_inside = (
        f"({dim(b)} = 1 OR exists({a}, {s} -> exists({_middles(s, b)}, {m} -> {location(b, m + '.x', m + '.y')} = 1)))"
    )
    probe = _inner_probe(a)
    poly_inside = (
        f"(NOT exists({b}, {t} -> {location(a, t + '.x1', t + '.y1')} = 1) AND "
        f"exists(slice({probe}, 1, 1), {m} -> {location(b, m + '.x', m + '.y')} = 1))"
    )
    return (
        f"(CASE WHEN {dim(a)} > {dim(b)} THEN false WHEN {dim(a)} = 0 THEN {point_case} "
        f"WHEN NOT {inside} THEN false WHEN NOT ({uncrossed} AND {mids}) THEN false "
        f"WHEN {dim(a)} = 1 THEN {line_inside} ELSE {poly_inside} END)"
    )


def contains(a: str, b: str) -> str:
    return within(b, a)


PREDICATES = {"intersects": intersects, "contains": contains, "within": within}


def point_segment_distance2(px: str, py: str, e: str) -> str:
    """Squared distance, with the foot kept on the segment."""
    t = var("t")
    foot = (
        f"greatest(0D, least(1D, coalesce(try_divide(({px} - {e}.x1) * ({e}.x2 - {e}.x1) + "
        f"({py} - {e}.y1) * ({e}.y2 - {e}.y1), pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2)), 0D)))"
    )
    return (
        f"transform(array({foot}), {t} -> pow({px} - {e}.x1 - {t} * ({e}.x2 - {e}.x1), 2) + "
        f"pow({py} - {e}.y1 - {t} * ({e}.y2 - {e}.y1), 2))[0]"
    )


def distance(a: str, b: str) -> str:
    """Of two segment arrays; 0 when they meet."""
    s, t = var("s"), var("t")
    pair = (
        f"least({point_segment_distance2(s + '.x1', s + '.y1', t)}, {point_segment_distance2(s + '.x2', s + '.y2', t)}, "
        f"{point_segment_distance2(t + '.x1', t + '.y1', s)}, {point_segment_distance2(t + '.x2', t + '.y2', s)})"
    )
    dots = (
        f"sqrt(pow({a}[0].x1 - {b}[0].x1, 2) + pow({a}[0].y1 - {b}[0].y1, 2))"
    )
    return (
        f"(CASE WHEN size({a}) = 1 AND size({b}) = 1 AND {a}[0].d = 0 AND {b}[0].d = 0 THEN {dots} "
        f"WHEN {intersects(a, b)} THEN 0D ELSE sqrt(array_min(transform({a}, {s} -> "
        f"array_min(transform({b}, {t} -> {pair}))))) END)"
    )


# ---- shapes made from one geometry ------------------------------------------

def fill_holes(g: str, max_area: float | None = None) -> str:
    """Polygons without their holes (or only the holes smaller than `max_area`)."""
    p, r, i = var("p"), var("r"), var("i")
    keep = f"{i} = 0" if max_area is None else f"{i} = 0 OR abs({ring_area2(r)}) / 2 >= {max_area!r}D"
    parts = (
        f"transform(({g}).parts, {p} -> CASE WHEN {p}.dim = 2 THEN named_struct('dim', 2, 'rings', "
        f"filter({p}.rings, ({r}, {i}) -> {keep})) ELSE {p} END)"
    )
    return f"CASE WHEN {is_polygon(g)} THEN {_geometry(f'({g}).kind', parts)} ELSE {g} END"


def drop_repeats(r: str) -> str:
    """A ring without consecutive equal vertices."""
    v, i = var("v"), var("i")
    return (
        f"filter({r}, ({v}, {i}) -> {i} = 0 OR {v}.x <> {r}[{i} - 1].x OR {v}.y <> {r}[{i} - 1].y)"
    )


def snap_to_grid(g: str, size: float) -> str:
    """Vertices rounded to the grid, repeats dropped; what collapses is left out."""
    v, t = var("v"), var("t")
    # a size like 0.1 has no exact double: multiplying by its reciprocal keeps 0.3 as 0.3
    inverse = 1 / size
    if inverse >= 1 and abs(inverse - round(inverse)) < 1e-9:
        snap = lambda c: f"rint({c} * {round(inverse)}D) / {round(inverse)}D"
    else:
        snap = lambda c: f"rint({c} / {size!r}D) * {size!r}D"
    moved = map_rings(g, lambda r, _p: (
        f"transform(array(transform({r}, {v} -> named_struct('x', {snap(v + '.x')} + 0D, 'y', {snap(v + '.y')} + 0D, "
        f"'z', {v}.z))), {t} -> {drop_repeats(t)})[0]"
    ))
    p, r, i, q, w = var("p"), var("r"), var("i"), var("q"), var("w")
    rings_left = f"filter({p}.rings, {r} -> {p}.dim < 2 OR abs({ring_area2(r)}) > 0)"
    kept = (
        f"filter(transform({q}.parts, {p} -> named_struct('dim', {p}.dim, 'rings', "
        f"CASE WHEN {p}.dim = 2 AND abs({ring_area2(p + '.rings[0]')}) = 0 THEN slice({p}.rings, 1, 0) "
        f"ELSE {rings_left} END)), {w} -> size({w}.rings) > 0 AND ({w}.dim = 0 OR size({w}.rings[0]) > 1))"
    )
    return f"transform(array({moved}), {q} -> CASE WHEN {q} IS NOT NULL THEN {_geometry(q + '.kind', kept)} END)[0]"


def circle(x: str, y: str, radius: str) -> str:
    """32-gon around a point: 8 segments to the quarter, clockwise from east as buffers run."""
    i = var("i")
    ring = (
        f"transform(sequence(0, 32), {i} -> "
        + vertex(f"{x} + {radius} * cos(-2 * pi() * ({i} % 32) / 32)", f"{y} + {radius} * sin(-2 * pi() * ({i} % 32) / 32)")
        + ")"
    )
    return polygon(f"array({ring})")


def normalized(g: str) -> str:
    """A canonical vertex list: lines run from their lower end, rings start at their lowest
    vertex and run one way, parts and holes are sorted."""
    p, r, k, i, s, q, t = (var(n) for n in ("p", "r", "k", "i", "s", "q", "t"))
    xy = f"transform({r}, {k} -> named_struct('x', {k}.x, 'y', {k}.y, 'z', {k}.z))"
    open_ring = f"slice({q}, 1, size({q}) - 1)"
    start = f"CAST(array_position({t}, array_min({t})) AS INT)"
    turned = f"concat(slice({t}, {start}, size({t})), slice({t}, 1, {start} - 1))"
    one_way = f"CASE WHEN {ring_area2(q)} < 0 THEN reverse({open_ring}) ELSE {open_ring} END"
    ring = (
        f"transform(array({xy}), {q} -> CASE WHEN {p}.dim = 2 AND size({q}) > 1 THEN "
        f"transform(array({one_way}), {t} -> {turned})[0] "
        f"WHEN {p}.dim = 1 THEN CASE WHEN reverse({q}) < {q} THEN reverse({q}) ELSE {q} END "
        f"ELSE {q} END)[0]"
    )
    rings = f"transform({p}.rings, {r} -> {ring})"
    whole = (
        f"CASE WHEN size({p}.rings) > 1 THEN transform(array({rings}), {s} -> "
        f"concat(slice({s}, 1, 1), array_sort(slice({s}, 2, size({s})))))[0] ELSE {rings} END"
    )
    return (
        f"CASE WHEN ({g}) IS NOT NULL THEN named_struct('kind', ({g}).kind, 'parts', "
        f"array_sort(transform(({g}).parts, {p} -> named_struct('dim', {p}.dim, 'rings', {whole})))) END"
    )


def force_2d(g: str) -> str:
    return map_vertices(g, lambda v: f"named_struct('x', {v}.x, 'y', {v}.y, 'z', CAST(NULL AS DOUBLE))")


def same_dimension(g: str, dim: str) -> str:
    """Only the parts of dimension `dim`."""
    p = var("p")
    return from_parts(f"filter(({g}).parts, {p} -> {p}.dim = {dim})")


def substring(ring: str, lo: str, hi: str) -> str:
    """The stretch of a line between two fractions of its 2D length, vertices and Z kept.

    `ring` has to be a plain column or lambda variable."""
    i, s, t, v, j = (var(n) for n in ("i", "s", "t", "v", "j"))
    step = (
        f"sqrt(pow({ring}[{i}].x - {ring}[{i} - 1].x, 2) + pow({ring}[{i}].y - {ring}[{i} - 1].y, 2))"
    )
    # running length at every vertex
    marks = (
        f"aggregate(CASE WHEN size({ring}) > 1 THEN sequence(1, size({ring}) - 1) ELSE CAST(array() AS ARRAY<INT>) END, "
        f"array(0D), ({s}, {i}) -> concat({s}, array(element_at({s}, -1) + {step})))"
    )
    def at(f: str) -> str:
        # the vertex at fraction f: exact at the ends, interpolated within its segment
        d, k, w = var("d"), var("k"), var("w")
        lerp = lambda c: (
            f"{ring}[{k}].{c} + ({ring}[{k} + 1].{c} - {ring}[{k}].{c}) * {w}"
        )
        seg = f"least(size({ring}) - 2, greatest(0, size(filter({t}, {v} -> {v} <= {d})) - 1))"
        frac = f"coalesce(try_divide({d} - {t}[{k}], {t}[{k} + 1] - {t}[{k}]), 0D)"
        return (
            f"CASE WHEN {f} <= 0 THEN {ring}[0] WHEN {f} >= 1 THEN element_at({ring}, -1) ELSE "
            f"transform(array({f} * element_at({t}, -1)), {d} -> transform(array({seg}), {k} -> "
            f"transform(array({frac}), {w} -> named_struct('x', {lerp('x')}, 'y', {lerp('y')}, 'z', {lerp('z')}))[0])[0])[0] END"
        )
    total = f"element_at({t}, -1)"
    eps = f"(1e-12 * {total})"
    inner = (
        f"filter({ring}, ({v}, {j}) -> {t}[{j}] > ({lo}) * {total} + {eps} AND {t}[{j}] < ({hi}) * {total} - {eps})"
    )
    return f"transform(array({marks}), {t} -> concat(array({at(lo)}), {inner}, array({at(hi)})))[0]"


def locate(ring: str, px: str, py: str) -> str:
    """Fraction of a line's length at the point of it closest to (px, py)."""
    i, s = var("i"), var("s")
    return (
        f"transform(array(aggregate({ring_segments(ring, '1')}, named_struct('run', 0D, 'best', CAST(NULL AS DOUBLE), 'at', 0D), "
        f"({s}, {i}) -> {_locate_step(s, i, px, py)})), {i} -> coalesce(try_divide({i}.at, {i}.run), 0D))[0]"
    )


def _locate_step(s: str, e: str, px: str, py: str) -> str:
    t, d = var("t"), var("d")
    size = f"sqrt(pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2))"
    foot = (
        f"greatest(0D, least(1D, coalesce(try_divide(({px} - {e}.x1) * ({e}.x2 - {e}.x1) + "
        f"({py} - {e}.y1) * ({e}.y2 - {e}.y1), pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2)), 0D)))"
    )
    dist = f"pow({px} - {e}.x1 - {t} * ({e}.x2 - {e}.x1), 2) + pow({py} - {e}.y1 - {t} * ({e}.y2 - {e}.y1), 2)"
    return (
        f"transform(array({foot}), {t} -> transform(array({dist}), {d} -> named_struct('run', {s}.run + {size}, "
        f"'best', CASE WHEN {s}.best IS NULL OR {d} < {s}.best THEN {d} ELSE {s}.best END, "
        f"'at', CASE WHEN {s}.best IS NULL OR {d} < {s}.best THEN {s}.run + {t} * {size} ELSE {s}.at END))[0])[0]"
    )


def reverse(g: str) -> str:
    return map_rings(g, lambda r, _p: f"reverse({r})")


def translate(g: str, dx: str, dy: str) -> str:
    return map_vertices(g, lambda v: f"named_struct('x', {v}.x + ({dx}), 'y', {v}.y + ({dy}), 'z', {v}.z)")


def boundary(g: str) -> str:
    """A polygon's rings as lines, a line's two ends as points."""
    p, r, a = var("p"), var("r"), var("a")
    as_lines = f"transform({p}.rings, {r} -> named_struct('dim', 1, 'rings', array({r})))"
    ends = (
        f"CASE WHEN {p}.rings[0][0] = element_at({p}.rings[0], -1) THEN CAST(array() AS ARRAY<{PART}>) ELSE "
        f"transform(array({p}.rings[0][0], element_at({p}.rings[0], -1)), {r} -> named_struct('dim', 0, 'rings', array(array({r})))) END"
    )
    parts = (
        f"flatten(transform(({g}).parts, {p} -> CASE {p}.dim WHEN 2 THEN {as_lines} WHEN 1 THEN {ends} "
        f"ELSE CAST(array() AS ARRAY<{PART}>) END))"
    )
    return f"transform(array({parts}), {a} -> {from_parts(a)})[0]"


def envelope(g: str) -> str:
    b = var("b")
    return (
        f"transform(array({bbox(g)}), {b} -> CASE WHEN {b} IS NOT NULL THEN "
        f"{box(b + '.xmin', b + '.ymin', b + '.xmax', b + '.ymax')} END)[0]"
    )


def is_valid(g: str) -> str:
    """No two segments of a polygon cross or overlap, and its rings are closed."""
    p, s, e, f, i, j, r = (var(n) for n in ("p", "s", "e", "f", "i", "j", "r"))
    segs = f"flatten(transform({p}.rings, {r} -> {ring_segments(r, '2')}))"
    crossing = f"exists({s}, {e} -> exists({s}, {f} -> {segments_cross(e, f)}))"
    # a ring touching or retracing itself: a vertex inside another of its segments
    touching = (
        f"exists({s}, {e} -> exists({s}, {f} -> {on_segment(e, f + '.x1', f + '.y1')} AND "
        f"NOT ({f}.x1 = {e}.x1 AND {f}.y1 = {e}.y1) AND NOT ({f}.x1 = {e}.x2 AND {f}.y1 = {e}.y2) AND "
        f"({_edge_cross(e, f + '.x2', f + '.y2')} = 0)))"
    )
    closed = f"forall({p}.rings, {r} -> size({r}) >= 4 AND {r}[0].x = element_at({r}, -1).x AND {r}[0].y = element_at({r}, -1).y)"
    return (
        f"forall(({g}).parts, {p} -> {p}.dim < 2 OR ({closed} AND transform(array({segs}), "
        f"{s} -> NOT ({crossing}) AND NOT ({touching}))[0]))"
    )
