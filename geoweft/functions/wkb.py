"""WKB, EWKB and GeoPackage blobs to the geometry struct and back, in Arrow batches.

Only used at the edges of a job (files and tables that hold geometry as bytes)."""
from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import GEOMETRY_TYPE

# ---- fixed values: WKB type codes, and EWKB's flag bits ----
KIND_CODES = {
    "POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4,
    "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7,
}
FLAG_Z, FLAG_M, FLAG_SRID = 0x80000000, 0x40000000, 0x20000000
# ------------------------------------------------------------
CODE_KINDS = {code: kind for kind, code in KIND_CODES.items()}

VERTEX_ARROW = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
PART_ARROW = pa.struct([("dim", pa.int32()), ("rings", pa.list_(pa.list_(VERTEX_ARROW)))])
GEOMETRY_ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(PART_ARROW))])


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, fmt: str):
        value = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return value

    def geometry(self) -> tuple[str, list]:
        end = "<" if self.data[self.at] == 1 else ">"
        self.at += 1
        (code,) = self.take(end + "I")
        has_z, has_m = bool(code & FLAG_Z), bool(code & FLAG_M)
        if code & FLAG_SRID:
            self.at += 4
        code &= 0x0FFFFFFF
        has_z |= code // 1000 in (1, 3)
        has_m |= code // 1000 in (2, 3)
        kind = CODE_KINDS[code % 1000]
        width = 2 + has_z + has_m

        def vertices(n: int) -> list[dict]:
            flat = self.take(f"{end}{n * width}d")
            return [
                {"x": flat[i], "y": flat[i + 1], "z": flat[i + 2] if has_z else None}
                for i in range(0, n * width, width)
            ]

        if kind == "POINT":
            (v,) = vertices(1)
            return kind, [] if v["x"] != v["x"] else [{"dim": 0, "rings": [[v]]}]
        (n,) = self.take(end + "I")
        if kind == "LINESTRING":
            return kind, [{"dim": 1, "rings": [vertices(n)]}] if n else []
        if kind == "POLYGON":
            return kind, [{"dim": 2, "rings": [vertices(*self.take(end + "I")) for _ in range(n)]}] if n else []
        return kind, [part for _ in range(n) for part in self.geometry()[1]]


def decode(data: bytes | None) -> dict | None:
    """One WKB / EWKB / GeoPackage blob; None when it is malformed."""
    if not data:
        return None
    try:
        start = 0
        if data[:2] == b"GP":  # GeoPackage header: flags say how long its envelope is
            start = 8 + (0, 32, 48, 48, 64)[(data[3] >> 1) & 7]
        kind, parts = _Reader(data, start).geometry()
    except (struct.error, IndexError, KeyError):
        return None
    return {"kind": kind, "parts": parts}


def _encode_part(part: dict) -> bytes:
    z = part["rings"][0][0]["z"] is not None
    code = part["dim"] + 1 + (1000 if z else 0)

    def ring(vs):
        return b"".join(
            struct.pack("<3d" if z else "<2d", v["x"], v["y"], *([v["z"] or 0.0] if z else [])) for v in vs
        )

    head = struct.pack("<BI", 1, code)
    if part["dim"] == 0:
        return head + ring(part["rings"][0])
    if part["dim"] == 1:
        return head + struct.pack("<I", len(part["rings"][0])) + ring(part["rings"][0])
    return head + struct.pack("<I", len(part["rings"])) + b"".join(
        struct.pack("<I", len(r)) + ring(r) for r in part["rings"]
    )


def encode(g: dict | None) -> bytes | None:
    if g is None:
        return None
    code, parts = KIND_CODES[g["kind"]], g["parts"]
    if not parts:
        body = struct.pack("<2d", float("nan"), float("nan")) if code == 1 else struct.pack("<I", 0)
        return struct.pack("<BI", 1, code) + body
    if code < 4:
        return _encode_part(parts[0])
    z = 1000 if parts[0]["rings"][0][0]["z"] is not None else 0
    return struct.pack("<BII", 1, code + z, len(parts)) + b"".join(map(_encode_part, parts))


@F.arrow_udf(GEOMETRY_TYPE)
def _from_wkb(blobs: pa.Array, _same: pa.Array) -> pa.Array:
    return pa.array([decode(b) for b in blobs.to_pylist()], GEOMETRY_ARROW)


@F.arrow_udf(T.BinaryType())
def _to_wkb(geoms: pa.Array, _same: pa.Array) -> pa.Array:
    return pa.array([encode(g) for g in geoms.to_pylist()], pa.binary())


# Marked nondeterministic so the planner computes each once. The argument goes in twice: an
# expression used twice isn't inlined, and an inlined one with nested lambdas would keep the
# function from being planned. (Arrow still carries the column once.)
_from_wkb, _to_wkb = _from_wkb.asNondeterministic(), _to_wkb.asNondeterministic()


def from_wkb(blob: Column) -> Column:
    """`blob` has to be a plain column."""
    return _from_wkb(blob, blob)


def to_wkb(geom: Column) -> Column:
    """`geom` has to be a plain column."""
    return _to_wkb(geom, geom)
