"""Cutting segments at each other, as SQL expressions.

The point where two segments cross is computed from the pair in one fixed order, so both
segments are cut at exactly the same coordinates; a segment touched by another's end is cut
at that very vertex."""
from __future__ import annotations

from .geometry import SEGMENT, _edge_cross, location, covered, segments_cross, var
from .text import let

# An end this close to a segment (coordinate units) touches it, where no grid is given.
TOUCH = 1e-9


def grid_inverse(largest: str) -> str:
    """Cells per unit of the precision grid for coordinates up to `largest`: 1e-7 units for
    UTM metres, never finer than 1e-12. Overlay works on coordinates rounded to it, so points
    that differ in their last bits only are one point."""
    return f"pow(10D, least(12D, 14D - ceil(log10(greatest({largest}, 1D)))))"


def on_grid(value: str, inverse: str | None) -> str:
    return value if inverse is None else f"(rint(({value}) * {inverse}) / {inverse} + 0D)"


def _touch(s: str, px: str, py: str, tol: str = f"{TOUCH!r}D") -> str:
    """Cut of `s` at a vertex lying on its inside, else NULL."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    size2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"try_divide(({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}, {size2})"
    near = f"pow({_edge_cross(s, px, py)}, 2) <= {tol} * {tol} * {size2}"
    apart = f"NOT ({px} = {s}.x1 AND {py} = {s}.y1) AND NOT ({px} = {s}.x2 AND {py} = {s}.y2)"
    inside = (
        f"{px} >= least({s}.x1, {s}.x2) - {tol} AND {px} <= greatest({s}.x1, {s}.x2) + {tol} AND "
        f"{py} >= least({s}.y1, {s}.y2) - {tol} AND {py} <= greatest({s}.y1, {s}.y2) + {tol}"
    )
    return let(t, lambda v: (
        f"CASE WHEN {inside} AND {near} AND {apart} AND {v} > 0 AND {v} < 1 THEN "
        f"named_struct('t', {v}, 'x', {px}, 'y', {py}) END"
    ))


def _crossing(s: str, e: str, inverse: str | None) -> str:
    """Cut of `s` where `e` properly crosses it."""
    def at(a: str, b: str) -> str:
        den = f"(({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1))"
        u = f"try_divide(({b}.x1 - {a}.x1) * ({b}.y2 - {b}.y1) - ({b}.y1 - {a}.y1) * ({b}.x2 - {b}.x1), {den})"
        return let(u, lambda v: (
            f"named_struct('x', {on_grid(f'{a}.x1 + {v} * ({a}.x2 - {a}.x1)', inverse)}, "
            f"'y', {on_grid(f'{a}.y1 + {v} * ({a}.y2 - {a}.y1)', inverse)})"
        ))
    key = lambda q: f"named_struct('a', {q}.x1, 'b', {q}.y1, 'c', {q}.x2, 'd', {q}.y2)"
    where = f"CASE WHEN {key(s)} < {key(e)} THEN {at(s, e)} ELSE {at(e, s)} END"
    along = lambda p: (
        f"CASE WHEN abs({s}.x2 - {s}.x1) >= abs({s}.y2 - {s}.y1) THEN try_divide({p}.x - {s}.x1, {s}.x2 - {s}.x1) "
        f"ELSE try_divide({p}.y - {s}.y1, {s}.y2 - {s}.y1) END"
    )
    return let(where, lambda p: f"named_struct('t', {along(p)}, 'x', {p}.x, 'y', {p}.y)")


def cuts(s: str, e: str, inverse: str | None = None) -> str:
    """Where segment `e` cuts segment `s`: ARRAY<STRUCT<t, x, y>>, ends of `s` not included.
    On a grid, an end within about a cell of a segment touches it."""
    v, k = var("v"), var("k")
    tol = f"{TOUCH!r}D" if inverse is None else f"(1.5D / {inverse})"
    touches = [_touch(s, f"{e}.x{i}", f"{e}.y{i}", tol) for i in (1, 2)]
    # ends of s on e: s isn't cut there, and they aren't crossings either
    own_ends = [_touch(e, f"{s}.x{i}", f"{s}.y{i}", tol) for i in (1, 2)]
    apart = (
        f"(greatest({s}.x1, {s}.x2) < least({e}.x1, {e}.x2) - {tol} OR greatest({e}.x1, {e}.x2) < least({s}.x1, {s}.x2) - {tol} "
        f"OR greatest({s}.y1, {s}.y2) < least({e}.y1, {e}.y2) - {tol} OR greatest({e}.y1, {e}.y2) < least({s}.y1, {s}.y2) - {tol})"
    )
    found = (
        f"transform(array(array({', '.join(touches)})), {k} -> CASE WHEN exists({k}, {v} -> {v} IS NOT NULL) THEN "
        f"filter({k}, {v} -> {v} IS NOT NULL) WHEN {segments_cross(s, e)} AND {own_ends[0]} IS NULL AND {own_ends[1]} IS NULL "
        f"THEN array({_crossing(s, e, inverse)}) ELSE filter({k}, {v} -> false) END)[0]"
    )
    return f"CASE WHEN {apart} THEN CAST(array() AS ARRAY<STRUCT<t: DOUBLE, x: DOUBLE, y: DOUBLE>>) ELSE {found} END"


def cut_up(s: str, others: str, inverse: str | None = None) -> str:
    """The pieces of segment `s` between its cuts by the segments `others`."""
    e, c, i, v = var("e"), var("c"), var("i"), var("v")
    inner = f"flatten(transform({others}, {e} -> {cuts(s, e, inverse)}))"
    whole = f"named_struct('d', {s}.d, 'x1', {s}.x1, 'y1', {s}.y1, 'x2', {s}.x2, 'y2', {s}.y2)"
    pieces = (
        f"transform(sequence(0, size({c}) - 2), {i} -> named_struct('d', {s}.d, 'x1', {c}[{i}].x, 'y1', {c}[{i}].y, "
        f"'x2', {c}[{i} + 1].x, 'y2', {c}[{i} + 1].y))"
    )
    long = f"{v} -> {v}.x1 <> {v}.x2 OR {v}.y1 <> {v}.y2"

    def between(found: str) -> str:
        marks = (
            f"array_sort(concat(array(named_struct('t', 0D, 'x', {s}.x1, 'y', {s}.y1)), {found}, "
            f"array(named_struct('t', 1D, 'x', {s}.x2, 'y', {s}.y2))))"
        )
        # most segments aren't cut: there is nothing to put in order
        return f"CASE WHEN size({found}) = 0 THEN filter(array({whole}), {long}) ELSE transform(array({marks}), {c} -> filter({pieces}, {long}))[0] END"

    return let(inner, between)


def beside(e: str, sign: int) -> tuple[str, str]:
    """A point just left (+1) or right (-1) of the middle of segment `e`."""
    step = f"greatest(1e-6, abs({e}.x1) * 1e-14 / greatest(abs({e}.x2 - {e}.x1) + abs({e}.y2 - {e}.y1), 1e-12), " \
           f"abs({e}.y1) * 1e-14 / greatest(abs({e}.x2 - {e}.x1) + abs({e}.y2 - {e}.y1), 1e-12))"
    return (
        f"(({e}.x1 + {e}.x2) / 2 - {sign} * ({e}.y2 - {e}.y1) * {step})",
        f"(({e}.y1 + {e}.y2) / 2 + {sign} * ({e}.x2 - {e}.x1) * {step})",
    )


def inside_edges(a: str, b: str, inverse: str | None = None) -> str:
    """Pieces of `a`'s polygon edges (inside on their left) with polygon `b` on their left."""
    s, p = var("s"), var("p")
    return (
        f"flatten(transform({a}, {s} -> filter({cut_up(s, b, inverse)}, {p} -> {location_beside(b, p)} = 1)))"
    )


def location_beside(segs: str, e: str) -> str:
    """Where the point just left of the middle of segment `e` lies (`location`), computed once."""
    x, y = beside(e, 1)
    return let(f"named_struct('x', {x}, 'y', {y})", lambda q: location(segs, f"{q}.x", f"{q}.y"))


def line_pieces(a: str, b: str, keep_inside: bool = True) -> str:
    """Pieces of `a`'s line segments lying in (or on) `b`, or outside it."""
    s, p = var("s"), var("p")
    test = covered(b, f"(({p}.x1 + {p}.x2) / 2)", f"(({p}.y1 + {p}.y2) / 2)")
    return (
        f"flatten(transform({a}, {s} -> filter({cut_up(s, b)}, {p} -> {'' if keep_inside else 'NOT '}{test})))"
    )


def runs(pieces: str) -> str:
    """Segments in order joined into lines wherever one starts at the end of the one before:
    an array of line parts."""
    acc, e, i = var("acc"), var("e"), var("i")
    start = f"named_struct('x', {e}.x1, 'y', {e}.y1, 'z', CAST(NULL AS DOUBLE))"
    end = f"named_struct('x', {e}.x2, 'y', {e}.y2, 'z', CAST(NULL AS DOUBLE))"
    last = f"element_at({acc}, -1)"
    joined = (
        f"CASE WHEN size({acc}) > 0 AND element_at({last}, -1).x = {e}.x1 AND element_at({last}, -1).y = {e}.y1 "
        f"THEN concat(slice({acc}, 1, size({acc}) - 1), array(concat({last}, array({end})))) "
        f"ELSE concat({acc}, array(array({start}, {end}))) END"
    )
    empty = "CAST(array() AS ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>>>)"
    return (
        f"transform(aggregate({pieces}, {empty}, ({acc}, {e}) -> {joined}), {i} -> "
        f"named_struct('dim', 1, 'rings', array({i})))"
    )


def edges_area(edges: str) -> str:
    """Area enclosed by directed edges with the inside on their left."""
    s, e = var("s"), var("e")
    o = f"{edges}[0]"
    return (
        f"CASE WHEN size({edges}) > 0 THEN aggregate({edges}, 0D, ({s}, {e}) -> {s} + "
        f"(({e}.x1 - {o}.x1) * ({e}.y2 - {o}.y1) - ({e}.x2 - {o}.x1) * ({e}.y1 - {o}.y1))) / 2 ELSE 0D END"
    )


def on_grid_segments(segs: str, inverse: str) -> str:
    """Segments with their ends on the precision grid; those that vanish are left out."""
    e = var("e")
    ends = ", ".join(f"'{c}', {on_grid(f'{e}.{c}', inverse)}" for c in ("x1", "y1", "x2", "y2"))
    return (
        f"filter(transform({segs}, {e} -> named_struct('d', {e}.d, {ends})), "
        f"{e} -> {e}.d = 0 OR {e}.x1 <> {e}.x2 OR {e}.y1 <> {e}.y2)"
    )


def oriented(g: str) -> str:
    """Segments with every polygon edge running so that the inside is on its left."""
    from .geometry import ring_area2, ring_segments

    p, r, k = var("p"), var("r"), var("k")
    ring = f"CASE WHEN {p}.dim = 2 AND ({ring_area2(r)} > 0) <> ({k} = 0) THEN reverse({r}) ELSE {r} END"
    return (
        f"flatten(transform(({g}).parts, {p} -> flatten(transform({p}.rings, ({r}, {k}) -> "
        f"{let(ring, lambda q: ring_segments(q, p + '.dim'))}))))"
    )


__all__ = ["cuts", "cut_up", "beside", "inside_edges", "line_pieces", "runs", "edges_area", "oriented", "SEGMENT"]
