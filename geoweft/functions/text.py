"""Geometry as text: WKT and GeoJSON, both ways, as SQL expressions."""
from __future__ import annotations

from .geometry import GEOMETRY, PART, RING, VERTEX, _geometry, from_parts, literal, var

# ---- fixed values: the geometry kinds by dimension, and GeoJSON's names for them -------
KINDS = ("POINT", "LINESTRING", "POLYGON")
GEOJSON_KINDS = {
    "Point": "POINT", "LineString": "LINESTRING", "Polygon": "POLYGON",
    "MultiPoint": "MULTIPOINT", "MultiLineString": "MULTILINESTRING",
    "MultiPolygon": "MULTIPOLYGON", "GeometryCollection": "GEOMETRYCOLLECTION",
}
COORDINATE_DDL = {
    "Point": "ARRAY<DOUBLE>", "LineString": "ARRAY<ARRAY<DOUBLE>>", "MultiPoint": "ARRAY<ARRAY<DOUBLE>>",
    "Polygon": "ARRAY<ARRAY<ARRAY<DOUBLE>>>", "MultiLineString": "ARRAY<ARRAY<ARRAY<DOUBLE>>>",
    "MultiPolygon": "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>",
}
# ----------------------------------------------------------------------------------------


def let(value: str, body) -> str:
    """`body(v)` with the value of an expression bound to the variable v."""
    v = var("l")
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def number(x: str) -> str:
    """A double in plain decimals: 10, 0.5, 12345678.25."""
    plain = f"rtrim('0', CAST(CAST({x} AS DECIMAL(38, 17)) AS STRING))"
    return (
        f"CASE WHEN {x} = rint({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS STRING) "
        f"WHEN abs({x}) < 1e-3 OR abs({x}) >= 1e7 THEN {plain} ELSE CAST({x} AS STRING) END"
    )


# ---- WKT out ----------------------------------------------------------------

def as_wkt(g: str) -> str:
    def coord(v):
        return (
            f"concat({number(v + '.x')}, ' ', {number(v + '.y')}, "
            f"CASE WHEN {v}.z IS NULL THEN '' ELSE concat(' ', {number(v + '.z')}) END)"
        )
    v, r, p, q, m = var("v"), var("r"), var("p"), var("q"), var("m")
    ring = lambda x: f"array_join(transform({x}, {v} -> {coord(v)}), ', ')"
    bare = f"{ring(p + '.rings[0]')}"
    rings = f"concat('(', array_join(transform({p}.rings, {r} -> concat('(', {ring(r)}, ')')), ', '), ')')"
    body = f"CASE {p}.dim WHEN 2 THEN {rings} WHEN 1 THEN concat('(', {bare}, ')') ELSE {bare} END"
    single = f"CASE {p}.dim WHEN 2 THEN {rings} ELSE concat('(', {bare}, ')') END"
    zed = f"CASE WHEN ({g}).parts[0].rings[0][0].z IS NULL THEN '' ELSE ' Z' END"
    member = (
        f"transform(({g}).parts, {p} -> concat(element_at(array('POINT', 'LINESTRING', 'POLYGON'), {p}.dim + 1), "
        f"{zed}, ' ', {single}))"
    )
    return (
        f"CASE WHEN ({g}) IS NULL THEN NULL WHEN size(({g}).parts) = 0 THEN concat(({g}).kind, ' EMPTY') "
        f"WHEN ({g}).kind = 'GEOMETRYCOLLECTION' THEN concat('GEOMETRYCOLLECTION', {zed}, ' (', array_join({member}, ', '), ')') "
        f"WHEN ({g}).kind LIKE 'MULTI%' THEN concat(({g}).kind, {zed}, ' (', array_join(transform(({g}).parts, {p} -> {body}), ', '), ')') "
        f"ELSE concat(({g}).kind, {zed}, ' ', transform(({g}).parts, {p} -> {single})[0]) END"
    )


# ---- GeoJSON out ------------------------------------------------------------

def as_geojson(g: str) -> str:
    v, r, p, m = var("v"), var("r"), var("p"), var("m")
    coord = (
        f"concat('[', CAST({v}.x AS STRING), ',', CAST({v}.y AS STRING), "
        f"CASE WHEN {v}.z IS NULL THEN '' ELSE concat(',', CAST({v}.z AS STRING)) END, ']')"
    )
    joined = lambda x: f"concat('[', array_join({x}, ','), ']')"
    ring = lambda x: joined(f"transform({x}, {v} -> {coord})")
    part = (
        f"CASE {p}.dim WHEN 2 THEN {joined(f'transform({p}.rings, {r} -> {ring(r)})')} "
        f"WHEN 1 THEN {ring(p + '.rings[0]')} ELSE transform({p}.rings[0], {v} -> {coord})[0] END"
    )
    names = ", ".join(f"'{k}', '{j}'" for j, k in GEOJSON_KINDS.items())
    name = f"map({names})[({g}).kind]"
    member = (
        f"transform(({g}).parts, {p} -> concat('{{\"type\":\"', element_at(array('Point', 'LineString', 'Polygon'), "
        f"{p}.dim + 1), '\",\"coordinates\":', {part}, '}}'))"
    )
    coords = (
        f"CASE WHEN size(({g}).parts) = 0 THEN '[]' WHEN ({g}).kind LIKE 'MULTI%' THEN "
        f"{joined(f'transform(({g}).parts, {p} -> {part})')} ELSE transform(({g}).parts, {p} -> {part})[0] END"
    )
    return (
        f"CASE WHEN ({g}) IS NULL THEN NULL WHEN ({g}).kind = 'GEOMETRYCOLLECTION' THEN "
        f"concat('{{\"type\":\"GeometryCollection\",\"geometries\":', {joined(member)}, '}}') "
        f"ELSE concat('{{\"type\":\"', {name}, '\",\"coordinates\":', {coords}, '}}') END"
    )


# ---- GeoJSON in -------------------------------------------------------------

def _vertex(c: str) -> str:
    return f"named_struct('x', {c}[0], 'y', {c}[1], 'z', CASE WHEN size({c}) > 2 THEN {c}[2] END)"


def _ring(coords: str) -> str:
    c = var("c")
    return f"transform({coords}, {c} -> {_vertex(c)})"


def _part(dim: int, rings: str) -> str:
    return f"named_struct('dim', {dim}, 'rings', {rings})"


def _json_parts(kind: str, c: str) -> str:
    """The parts of a GeoJSON geometry of one type from its decoded coordinates `c`."""
    e, r = var("e"), var("r")
    if kind == "Point":
        return f"array({_part(0, f'array(array({_vertex(c)}))')})"
    if kind == "LineString":
        return f"array({_part(1, f'array({_ring(c)})')})"
    if kind == "Polygon":
        return f"array({_part(2, f'transform({c}, {r} -> {_ring(r)})')})"
    if kind == "MultiPoint":
        return f"transform({c}, {e} -> {_part(0, f'array(array({_vertex(e)}))')})"
    if kind == "MultiLineString":
        return f"transform({c}, {e} -> {_part(1, f'array({_ring(e)})')})"
    return f"transform({c}, {e} -> {_part(2, f'transform({e}, {r} -> {_ring(r)})')})"


def _one_geojson(kind: str, coordinates: str) -> str:
    """NULL for an unknown type, broken coordinates, or a vertex without two numbers."""
    cases = []
    for name, ddl in COORDINATE_DDL.items():
        decoded = f"from_json({coordinates}, '{ddl}')"
        made = let(decoded, lambda c, name=name: (
            f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN size({c}) = 0 THEN CAST(array() AS ARRAY<{PART}>) "
            f"ELSE {_json_parts(name, c)} END END"
        ))
        cases.append(f"WHEN '{name}' THEN {_geometry(literal(GEOJSON_KINDS[name]), made)}")
    g, p, r, v = var("g"), var("p"), var("r"), var("v")
    sound = (
        f"forall({g}.parts, {p} -> forall({p}.rings, {r} -> forall({r}, {v} -> {v}.x IS NOT NULL AND {v}.y IS NOT NULL)))"
    )
    return f"transform(array(CASE {kind} {' '.join(cases)} END), {g} -> CASE WHEN {g}.parts IS NOT NULL AND {sound} THEN {g} END)[0]"


def from_geojson_parts(kind: str, coordinates: str) -> str:
    """From a geometry's type and its raw `coordinates` text."""
    return _one_geojson(kind, coordinates)


def from_geojson(text: str) -> str:
    ddl = "STRUCT<type: STRING, coordinates: STRING, geometries: ARRAY<STRUCT<type: STRING, coordinates: STRING>>>"
    q, m = var("q"), var("m")
    members = (
        f"flatten(transform({q}.geometries, {m} -> {_one_geojson(m + '.type', m + '.coordinates')}.parts))"
    )
    return (
        f"transform(array(from_json({text}, '{ddl}')), {q} -> CASE WHEN {q}.type = 'GeometryCollection' THEN "
        f"{_geometry(literal('GEOMETRYCOLLECTION'), members)} ELSE {_one_geojson(q + '.type', q + '.coordinates')} END)[0]"
    )


# ---- WKT in -----------------------------------------------------------------

def from_wkt(text: str) -> str:
    """Points, lines, polygons and their MULTI kinds; anything else is NULL."""
    c = var("c")
    def ring(body: str) -> str:
        return let(
            f"transform(split(regexp_replace({body}, '[()]', ' '), ','), {c} -> split(trim({c}), ' +'))",
            lambda cs: f"transform({cs}, {c} -> named_struct('x', try_cast({c}[0] AS DOUBLE), "
                       f"'y', try_cast(try_element_at({c}, 2) AS DOUBLE), 'z', try_cast(try_element_at({c}, 3) AS DOUBLE)))",
        )
    r, e = var("r"), var("e")
    # the text between the outermost brackets, with the nesting turned into separators
    def build(kind: str, body: str) -> str:
        flat = f"regexp_replace({body}, '[)] *, *[(]', '|')"
        polys = f"split(regexp_replace({body}, '[)] *[)] *, *[(] *[(]', '#'), '#')"
        rings_of = lambda t: f"transform(split(regexp_replace({t}, '[)] *, *[(]', '|'), '[|]'), {r} -> {ring(r)})"
        return (
            f"CASE {kind} WHEN 'POINT' THEN array({_part(0, f'array({ring(body)})')}) "
            f"WHEN 'LINESTRING' THEN array({_part(1, f'array({ring(body)})')}) "
            f"WHEN 'POLYGON' THEN array({_part(2, rings_of(body))}) "
            f"WHEN 'MULTIPOINT' THEN transform({ring(body)}, {e} -> {_part(0, f'array(array({e}))')}) "
            f"WHEN 'MULTILINESTRING' THEN transform(split({flat}, '[|]'), {e} -> {_part(1, f'array({ring(e)})')}) "
            f"WHEN 'MULTIPOLYGON' THEN transform({polys}, {e} -> {_part(2, rings_of(e))}) END"
        )
    kind = f"upper(regexp_extract(trim({text}), '^([A-Za-z]+)', 1))"
    body = f"regexp_extract({text}, '[(](.*)[)]', 1)"
    g, p, q, v = var("g"), var("p"), var("q"), var("v")
    sound = (
        f"forall({g}.parts, {p} -> forall({p}.rings, {q} -> forall({q}, {v} -> {v}.x IS NOT NULL AND {v}.y IS NOT NULL)))"
    )
    parts = let(kind, lambda k: let(body, lambda b: _geometry(k, build(k, b))))
    known = ", ".join(f"'{prefix}{k}'" for prefix in ("", "MULTI") for k in KINDS) + ", 'GEOMETRYCOLLECTION'"
    return (
        f"CASE WHEN upper(trim({text})) LIKE '% EMPTY' AND {kind} IN ({known}) THEN {_geometry(kind, 'array()')} "
        f"ELSE transform(array({parts}), {g} -> CASE WHEN {g}.parts IS NOT NULL AND {sound} THEN {g} END)[0] END"
    )


__all__ = [
    "as_geojson", "as_wkt", "from_geojson", "from_geojson_parts", "from_parts", "from_wkt", "let", "number",
    "GEOMETRY", "PART", "RING", "VERTEX",
]
