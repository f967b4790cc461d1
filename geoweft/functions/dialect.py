"""SQL functions for expressions in a pipeline: geometry, and names Spark spells differently.

They are temporary SQL functions, so Catalyst inlines them: no Python runs for them."""
from __future__ import annotations

import re

from pyspark.sql import SparkSession

from . import codes, crs, noding
from . import geometry as geo
from . import text
from .geometry import GEOMETRY

POINT_FIRST = "g.parts[0].rings[0][0]"


def _geometry_functions() -> dict[str, tuple[str, str, str]]:
    """{name: (parameters, result type, SQL)}."""
    one, two = f"g {GEOMETRY}", f"a {GEOMETRY}, b {GEOMETRY}"

    def pair(fn) -> str:
        """Of two geometries, by their segments; NULL when either is NULL or empty."""
        s = text.let(geo.segments("a"), lambda x: text.let(geo.segments("b"), lambda y: (
            f"CASE WHEN size({x}) > 0 AND size({y}) > 0 THEN {fn(x, y)} END")))
        return f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {s} END"

    def bound(which: str) -> str:
        return f"({geo.bbox('g')}).{which}"

    def line_ring(fn) -> str:
        return text.let("g.parts[0].rings[0]", fn)

    end = lambda at: f"CASE WHEN {geo.is_line('g')} THEN {geo.point(at + '.x', at + '.y')} END"
    along = line_ring(lambda r: text.let(geo.substring(r, "f", "1D"), lambda s: geo.point(f"{s}[0].x", f"{s}[0].y")))
    cut = line_ring(lambda r: geo.line(geo.substring(r, "lo", "hi")))
    place = line_ring(lambda r: geo.locate(r, "p.parts[0].rings[0][0].x", "p.parts[0].rings[0][0].y"))
    nearest = text.let(geo.segments("a"), lambda s: text.let("b.parts[0].rings[0][0]", lambda p: _closest(s, p)))
    multi = geo._geometry("CASE WHEN g.kind LIKE 'MULTI%' OR g.kind = 'GEOMETRYCOLLECTION' THEN g.kind ELSE concat('MULTI', g.kind) END", "g.parts")
    return {
        "st_area": (one, "DOUBLE", geo.area("g")),
        "st_length": (one, "DOUBLE", geo.length("g")),
        "st_perimeter": (one, "DOUBLE", geo.perimeter("g")),
        "st_x": (one, "DOUBLE", f"CASE WHEN g.kind = 'POINT' AND size(g.parts) > 0 THEN {POINT_FIRST}.x END"),
        "st_y": (one, "DOUBLE", f"CASE WHEN g.kind = 'POINT' AND size(g.parts) > 0 THEN {POINT_FIRST}.y END"),
        "st_xmin": (one, "DOUBLE", bound("xmin")), "st_ymin": (one, "DOUBLE", bound("ymin")),
        "st_xmax": (one, "DOUBLE", bound("xmax")), "st_ymax": (one, "DOUBLE", bound("ymax")),
        "st_npoints": (one, "INT", geo.npoints("g")),
        "st_dimension": (one, "INT", f"coalesce({geo.dimension('g')}, CASE WHEN g.kind LIKE '%POINT' THEN 0 WHEN g.kind LIKE '%LINESTRING' THEN 1 WHEN g.kind LIKE '%POLYGON' THEN 2 END)"),
        "st_isempty": (one, "BOOLEAN", f"CASE WHEN g IS NOT NULL THEN {geo.is_empty('g')} END"),
        "st_isvalid": (one, "BOOLEAN", geo.is_valid("g")),
        "st_geometrytype": (one, "STRING", "g.kind"),
        "st_astext": (one, "STRING", text.as_wkt("g")),
        "st_asgeojson": (one, "STRING", text.as_geojson("g")),
        "st_geomfromtext": ("t STRING", GEOMETRY, text.from_wkt("t")),
        "st_geomfromgeojson": ("t STRING", GEOMETRY, text.from_geojson("t")),
        "st_point": ("x DOUBLE, y DOUBLE", GEOMETRY, geo.point("x", "y")),
        "st_makeenvelope": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", GEOMETRY, geo.box("x0", "y0", "x1", "y1")),
        "st_centroid": (one, GEOMETRY, geo.centroid("g")),
        "st_envelope": (one, GEOMETRY, geo.envelope("g")),
        "st_boundary": (one, GEOMETRY, geo.boundary("g")),
        "st_exteriorring": (one, GEOMETRY, f"CASE WHEN g.kind = 'POLYGON' AND size(g.parts) > 0 THEN {geo.line('g.parts[0].rings[0]')} END"),
        "st_pointonsurface": (one, GEOMETRY, _inner_point()),
        "st_startpoint": (one, GEOMETRY, end("g.parts[0].rings[0][0]")),
        "st_endpoint": (one, GEOMETRY, end("element_at(element_at(g.parts, -1).rings[0], -1)")),
        "st_reverse": (one, GEOMETRY, geo.reverse("g")),
        "st_translate": (f"{one}, dx DOUBLE, dy DOUBLE", GEOMETRY, geo.translate("g", "dx", "dy")),
        "st_force2d": (one, GEOMETRY, geo.force_2d("g")),
        "st_multi": (one, GEOMETRY, f"CASE WHEN g IS NOT NULL THEN {multi} END"),
        "st_collectionextract": (f"{one}, kind INT", GEOMETRY, f"CASE WHEN g IS NOT NULL THEN {geo.same_dimension('g', '(kind - 1)')} END"),
        "st_normalize": (one, GEOMETRY, geo.normalized("g")),
        "st_lineinterpolatepoint": (f"{one}, f DOUBLE", GEOMETRY, along),
        "st_linesubstring": (f"{one}, lo DOUBLE, hi DOUBLE", GEOMETRY, cut),
        "st_linelocatepoint": (f"{one}, p {GEOMETRY}", "DOUBLE", place),
        "st_closestpoint": (two, GEOMETRY, nearest),
        "st_distance": (two, "DOUBLE", pair(geo.distance)),
        "st_dwithin": (f"{two}, r DOUBLE", "BOOLEAN", pair(lambda x, y: f"({geo.distance(x, y)} <= r)")),
        "st_intersects": (two, "BOOLEAN", pair(geo.intersects)),
        "st_contains": (two, "BOOLEAN", pair(geo.contains)),
        "st_within": (two, "BOOLEAN", pair(geo.within)),
        "to_geohash": ("lon DOUBLE, lat DOUBLE", "STRING", codes.geohash("lon", "lat")),
        "to_mgrs": ("lon DOUBLE, lat DOUBLE", "STRING", codes.mgrs("lon", "lat")),
    }


def _closest(segs: str, p: str) -> str:
    """The point of a geometry's segments closest to vertex `p`."""
    e, t = geo.var("e"), geo.var("t")
    foot = (
        f"greatest(0D, least(1D, coalesce(try_divide(({p}.x - {e}.x1) * ({e}.x2 - {e}.x1) + ({p}.y - {e}.y1) * ({e}.y2 - {e}.y1), "
        f"pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2)), 0D)))"
    )
    best = (
        f"array_min(transform({segs}, {e} -> named_struct('d', {geo.point_segment_distance2(p + '.x', p + '.y', e)}, "
        f"'x', {e}.x1 + ({e}.x2 - {e}.x1) * {foot}, 'y', {e}.y1 + ({e}.y2 - {e}.y1) * {foot})))"
    )
    return f"transform(array({best}), {t} -> {geo.point(t + '.x', t + '.y')})[0]"


def _inner_point() -> str:
    """The centroid where it lies in the geometry, else a point just inside its first edge."""
    inside = text.let(geo.segments("g"), lambda s: text.let(geo.centroid("g"), lambda c: text.let(
        f"{c}.parts[0].rings[0][0]", lambda v: (
            f"CASE WHEN {geo.covered(s, v + '.x', v + '.y')} THEN {c} ELSE "
            + text.let(f"coalesce(try_element_at({geo._inner_probe(s)}, 1), named_struct('x', {s}[0].x1, 'y', {s}[0].y1))",
                       lambda q: geo.point(q + ".x", q + ".y")) + " END"))))
    return f"CASE WHEN size(g.parts) > 0 THEN {inside} END"


# ---- fixed values: strftime's codes and the date patterns they stand for ----
DATE_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%f": "SSSSSS",
}
# ------------------------------------------------------------------------------


def _pattern(fmt: str) -> str:
    for code, pattern in DATE_CODES.items():
        fmt = f"replace({fmt}, '{code}', '{pattern}')"
    return fmt


def _crossed(unit: str) -> str:
    """Boundaries of `unit` crossed between two timestamps."""
    months = "(year(b) * 12 + month(b) - year(a) * 12 - month(a))"
    seconds = lambda part: f"(unix_seconds(date_trunc('{part}', b)) - unix_seconds(date_trunc('{part}', a)))"
    return {
        "year": "year(b) - year(a)", "quarter": "(year(b) * 4 + quarter(b)) - (year(a) * 4 + quarter(a))",
        "month": months, "week": f"{seconds('week')} DIV 604800", "day": "datediff(b, a)",
        "hour": f"{seconds('hour')} DIV 3600", "minute": f"{seconds('minute')} DIV 60", "second": seconds("second"),
    }[unit]


def _sql_functions() -> dict[str, tuple[str, str, str]]:
    units = " ".join(f"WHEN '{u}' THEN CAST({_crossed(u)} AS BIGINT)" for u in (
        "year", "quarter", "month", "week", "day", "hour", "minute", "second"))
    return {
        "iff": ("c BOOLEAN, a STRING, b STRING", "STRING", "CASE WHEN c THEN a ELSE b END"),
        "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
        "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "s RLIKE p"),
        "strftime": ("t TIMESTAMP, f STRING", "STRING", f"date_format(t, {_pattern('f')})"),
        "strptime": ("s STRING, f STRING", "TIMESTAMP", f"to_timestamp(s, {_pattern('f')})"),
        "try_strptime": ("s STRING, f STRING", "TIMESTAMP", f"try_to_timestamp(s, {_pattern('f')})"),
        "date_diff_crossed": ("unit STRING, a TIMESTAMP, b TIMESTAMP", "BIGINT", f"CASE lower(unit) {units} END"),
        "epoch_ms": ("ms BIGINT", "TIMESTAMP", "timestamp_millis(ms)"),
    }


def register(spark: SparkSession, used_in: str | None = None) -> SparkSession:
    """Define the functions in a session: all of them, or those a text of expressions names."""
    wanted = {**_geometry_functions(), **_sql_functions()}
    if used_in is not None:
        words = set(re.findall(r"\w+", used_in.lower()))
        wanted = {n: f for n, f in wanted.items() if n in words}
    for name, (params, result, body) in wanted.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return spark


__all__ = ["register", "noding"]
