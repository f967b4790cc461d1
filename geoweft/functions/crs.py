"""Coordinate systems with closed-form projections, as SQL expressions over vertices:
geographic WGS84/ETRS89, UTM (both hemispheres, WGS84 and ETRS89) and Web Mercator."""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

from .geometry import map_vertices
from .text import let

# ---- fixed values: ellipsoids, UTM's constants, the geographic codes handled ----
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101)}
UTM_SCALE, UTM_EASTING, UTM_SOUTH_NORTHING = 0.9996, 500000.0, 10000000.0
WEB_MERCATOR_RADIUS = 6378137.0
GEOGRAPHIC = ("EPSG:4326", "EPSG:4258", "OGC:CRS84")
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Crs:
    kind: str  # "geographic", "utm" or "mercator"
    ellipsoid: str = "WGS84"
    zone: int = 0
    south: bool = False

    @property
    def in_degrees(self) -> bool:
        return self.kind == "geographic"


def lookup(code: str) -> Crs | None:
    """The CRS of an AUTHORITY:CODE name, None when it isn't one of the family handled."""
    code = code.upper()
    if code in GEOGRAPHIC:
        return Crs("geographic", "GRS80" if code == "EPSG:4258" else "WGS84")
    if code in ("EPSG:3857", "EPSG:900913"):
        return Crs("mercator")
    m = re.fullmatch(r"EPSG:(326|327|258)(\d\d)", code)
    if m and 1 <= int(m[2]) <= 60 and (m[1] != "258" or 28 <= int(m[2]) <= 38):
        return Crs("utm", "GRS80" if m[1] == "258" else "WGS84", int(m[2]), m[1] == "327")
    return None


def require(code: str, path: str = "") -> Crs:
    crs = lookup(code)
    if crs is None:
        where = f"\n{path}\n  only WGS84/ETRS89 longitude-latitude, their UTM zones and Web Mercator are known" if path else ""
        raise ValueError(f"unknown CRS '{code}'{where}")
    return crs


@dataclass(frozen=True)
class _Kruger:
    """The series of a transverse Mercator projection, to the fourth order in n."""

    radius: float
    ecc: float
    forward: tuple[float, ...]
    inverse: tuple[float, ...]
    latitude: tuple[float, ...]


def _kruger(ellipsoid: str) -> _Kruger:
    a, inv_f = ELLIPSOIDS[ellipsoid]
    n = (1 / inv_f) / (2 - 1 / inv_f)
    n2, n3, n4 = n * n, n**3, n**4
    return _Kruger(
        radius=a / (1 + n) * (1 + n2 / 4 + n4 / 64),
        ecc=2 * math.sqrt(n) / (1 + n),
        forward=(
            n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440,
            61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280,
        ),
        inverse=(
            n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440,
            17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280,
        ),
        latitude=(
            2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45,
            56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630,
        ),
    )


def _xy(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def utm_forward(lon: str, lat: str, zone: str, ellipsoid: str = "WGS84") -> str:
    """STRUCT<x, y>: easting and northing (north of the equator) in a zone given as SQL."""
    k = _kruger(ellipsoid)
    scale = UTM_SCALE * k.radius

    def body(t, dl):
        xi0 = f"atan2({t}, cos({dl}))"
        eta0 = f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
        def series(xi, eta):
            east = " + ".join(f"{c!r}D * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(k.forward, 1))
            north = " + ".join(f"{c!r}D * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(k.forward, 1))
            return _xy(f"{UTM_EASTING}D + {scale!r}D * ({eta} + {east})", f"{scale!r}D * ({xi} + {north})")
        return let(xi0, lambda xi: let(eta0, lambda eta: series(xi, eta)))

    conformal = lambda s: f"sinh(atanh({s}) - {k.ecc!r}D * atanh({k.ecc!r}D * {s}))"
    return let(
        f"sin(radians({lat}))",
        lambda s: let(conformal(s), lambda t: let(f"radians({lon} - (6D * ({zone}) - 183D))", lambda dl: body(t, dl))),
    )


def utm_inverse(x: str, y: str, crs: Crs) -> str:
    """STRUCT<x, y>: longitude and latitude."""
    k = _kruger(crs.ellipsoid)
    scale = UTM_SCALE * k.radius
    shift = UTM_SOUTH_NORTHING if crs.south else 0.0

    def angles(xi, eta):
        xi1 = f"{xi} - (" + " + ".join(f"{c!r}D * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(k.inverse, 1)) + ")"
        eta1 = f"{eta} - (" + " + ".join(f"{c!r}D * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(k.inverse, 1)) + ")"
        def back(p, q):
            chi = f"asin(sin({p}) / cosh({q}))"
            lat = lambda c: f"{c} + " + " + ".join(f"{d!r}D * sin({2 * j} * {c})" for j, d in enumerate(k.latitude, 1))
            return let(chi, lambda c: _xy(
                f"{6 * crs.zone - 183}D + degrees(atan2(sinh({q}), cos({p})))", f"degrees({lat(c)})",
            ))
        return let(xi1, lambda p: let(eta1, lambda q: back(p, q)))

    return let(
        f"({y} - {shift!r}D) / {scale!r}D",
        lambda xi: let(f"({x} - {UTM_EASTING!r}D) / {scale!r}D", lambda eta: angles(xi, eta)),
    )


def _to_lonlat(x: str, y: str, crs: Crs) -> str:
    if crs.kind == "utm":
        return utm_inverse(x, y, crs)
    if crs.kind == "mercator":
        r = WEB_MERCATOR_RADIUS
        return _xy(f"degrees({x} / {r!r}D)", f"degrees(2 * atan(exp({y} / {r!r}D)) - pi() / 2)")
    return _xy(x, y)


def _from_lonlat(lon: str, lat: str, crs: Crs) -> str:
    if crs.kind == "utm":
        north = utm_forward(lon, lat, str(crs.zone), crs.ellipsoid)
        if crs.south:
            return let(north, lambda p: _xy(f"{p}.x", f"{p}.y + {UTM_SOUTH_NORTHING!r}D"))
        return north
    if crs.kind == "mercator":
        r = WEB_MERCATOR_RADIUS
        return _xy(f"radians({lon}) * {r!r}D", f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {r!r}D")
    return _xy(lon, lat)


def transform_xy(x: str, y: str, source: str, target: str) -> str:
    """STRUCT<x, y> of a coordinate pair in another CRS (x is the longitude or easting)."""
    a, b = require(source), require(target)
    if a == b or (a.in_degrees and b.in_degrees):
        return _xy(x, y)
    if a.in_degrees:
        return _from_lonlat(x, y, b)
    if b.in_degrees:
        return _to_lonlat(x, y, a)
    return let(_to_lonlat(x, y, a), lambda p: _from_lonlat(f"{p}.x", f"{p}.y", b))


def transform(g: str, source: str, target: str) -> str:
    """The geometry in another CRS; the text itself when both are the same."""
    a, b = require(source), require(target)
    if a == b or (a.in_degrees and b.in_degrees):
        return g
    return map_vertices(g, lambda v: let(
        transform_xy(f"{v}.x", f"{v}.y", source, target),
        lambda p: f"named_struct('x', {p}.x, 'y', {p}.y, 'z', {v}.z)",
    ))
