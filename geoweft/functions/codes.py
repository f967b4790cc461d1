"""Geohash and MGRS references of a longitude/latitude pair, as SQL expressions."""
from __future__ import annotations

from .crs import utm_forward
from .geometry import var
from .text import let

# ---- fixed values: the geohash alphabet and length, MGRS's letters ----
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
GEOHASH_LENGTH = 12
MGRS_BANDS = "CDEFGHJKLMNPQRSTUVWXX"  # 8° each from 80°S, the last one 12°
MGRS_COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")  # by zone number modulo 3
MGRS_ROWS = "ABCDEFGHJKLMNPQRSTUV"  # every 100 km, shifted by 5 in even zones
# -----------------------------------------------------------------------


def geohash(lon: str, lat: str) -> str:
    """12 characters; NULL outside the valid range."""
    i, b, s, k = var("i"), var("b"), var("s"), var("k")
    half = GEOHASH_LENGTH * 5 // 2
    top = (1 << half) - 1

    def cell(v: str, span: int) -> str:
        return f"least({top}L, CAST(floor(({v} + {span // 2}D) / {span}D * {1 << half}D) AS BIGINT))"

    # even bits are the longitude's, odd bits the latitude's, highest first
    bit = lambda x, y: (
        f"(CASE WHEN (5 * {i} + {b}) % 2 = 0 THEN {x} ELSE {y} END "
        f"DIV shiftleft(1L, {half - 1} - CAST((5 * {i} + {b}) DIV 2 AS INT))) % 2"
    )
    text = lambda x, y: (
        f"array_join(transform(sequence(0, {GEOHASH_LENGTH - 1}), {i} -> substring('{GEOHASH_ALPHABET}', "
        f"CAST(aggregate(sequence(0, 4), 0L, ({s}, {b}) -> 2 * {s} + {bit(x, y)}) AS INT) + 1, 1)), '')"
    )
    coded = let(cell(lon, 360), lambda x: let(cell(lat, 180), lambda y: text(x, y)))
    return f"CASE WHEN {lon} BETWEEN -180 AND 180 AND {lat} BETWEEN -90 AND 90 THEN {coded} END"


def mgrs(lon: str, lat: str) -> str:
    """1 m reference; NULL outside 80°S to 84°N."""
    usual = f"least(60, CAST(floor(({lon} + 180D) / 6D) AS INT) + 1)"
    # the widened zones of south-west Norway and Svalbard
    zone = (
        f"CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32 "
        f"WHEN {lat} >= 72 AND {lon} >= 0 AND {lon} < 9 THEN 31 WHEN {lat} >= 72 AND {lon} >= 9 AND {lon} < 21 THEN 33 "
        f"WHEN {lat} >= 72 AND {lon} >= 21 AND {lon} < 33 THEN 35 WHEN {lat} >= 72 AND {lon} >= 33 AND {lon} < 42 THEN 37 "
        f"ELSE {usual} END"
    )
    columns = ", ".join(f"'{c}'" for c in MGRS_COLUMNS)

    def body(z: str, p: str) -> str:
        band = f"substring('{MGRS_BANDS}', CAST(floor(({lat} + 80D) / 8D) AS INT) + 1, 1)"
        north = f"(CASE WHEN {lat} < 0 THEN {p}.y + 10000000D ELSE {p}.y END)"
        col = f"substring(element_at(array({columns}), ({z} - 1) % 3 + 1), CAST(floor({p}.x / 100000D) AS INT), 1)"
        row = (
            f"substring('{MGRS_ROWS}', CAST((floor({north} / 100000D) + CASE WHEN {z} % 2 = 0 THEN 5 ELSE 0 END) % 20 AS INT) + 1, 1)"
        )
        digits = lambda v: f"lpad(CAST(CAST(floor({v}) % 100000 AS INT) AS STRING), 5, '0')"
        return f"concat(lpad(CAST({z} AS STRING), 2, '0'), {band}, {col}, {row}, {digits(p + '.x')}, {digits(north)})"

    text = let(zone, lambda z: let(utm_forward(lon, lat, z), lambda p: body(z, p)))
    return f"CASE WHEN {lon} BETWEEN -180 AND 180 AND {lat} BETWEEN -80 AND 84 THEN {text} END"
