"""Unions and differences of a few polygons, for many rows at a time, in numpy.

The same steps as across rows (`operators/overlay.py`): edges are cut where they meet, each piece
is kept or dropped by what lies beside its middle, and what is kept bounds the result."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from .planar import Pyramid, boxes_of

# Edges of the rows that are worked on at once, and pairs of a point and an edge looked at at once.
EDGES = 20_000
PAIRS = 1_000_000


def _counts(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of things in groups of these sizes: the group of each and its place there."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - (np.cumsum(counts) - counts)[group]


def spans(sizes: np.ndarray, most: int):
    """(begin, end) of runs of things that have together no more than `most`, or of a single one."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


class Faces:
    """Polygons of rows (lists of `side` and `parts`) as edges on the grid, inside on their left."""

    def __init__(self, rows: pa.ListArray, inverse: float):
        faces = rows.flatten()
        parts = faces.field("parts")
        rings = parts.flatten().field("rings")
        lines = rings.flatten()
        v = lines.flatten()
        xy = np.stack([v.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1).reshape(-1, 2).astype(float)
        self.rows = len(rows)
        self.row, _ = _spans(_counts(rows))
        self.is_b = np.array(faces.field("side").to_pylist(), dtype=object) == "b"
        face_of_part, _ = _spans(_counts(parts))
        part_of_ring, place = _spans(_counts(rings))
        sizes = _counts(lines)
        ring, at = _spans(sizes)
        follows = np.flatnonzero(at[1:] > 0) if len(at) else at
        of = ring[follows]
        first = (np.cumsum(sizes) - sizes)[of]
        d, e = xy[follows] - xy[first], xy[follows + 1] - xy[first]
        turn = np.bincount(of, d[:, 0] * e[:, 1] - e[:, 0] * d[:, 1], minlength=len(sizes))
        turn[sizes < 4] = 0
        back = ((turn > 0) != (place == 0))[of]
        ends = np.concatenate([xy[follows], xy[follows + 1]], axis=1)
        ends = np.rint(np.where(back[:, None], ends[:, [2, 3, 0, 1]], ends) * inverse) / inverse + 0.0
        some = (ends[:, :2] != ends[:, 2:]).any(axis=1)
        self.ends = ends[some]
        self.face = face_of_part[part_of_ring[of[some]]]


def _touch(s: np.ndarray, p: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether points lie on the inside of edges, and how far along (`noding._touch`)."""
    d = s[:, 2:] - s[:, :2]
    size = (d * d).sum(axis=1)
    t = ((p - s[:, :2]) * d).sum(axis=1) / size
    off = d[:, 0] * (p[:, 1] - s[:, 1]) - (p[:, 0] - s[:, 0]) * d[:, 1]
    low, high = np.minimum(s[:, :2], s[:, 2:]) - tol, np.maximum(s[:, :2], s[:, 2:]) + tol
    on = (off * off <= tol * tol * size) & (t > 0) & (t < 1) & (p >= low).all(axis=1) & (p <= high).all(axis=1)
    return on & (p != s[:, :2]).any(axis=1) & (p != s[:, 2:]).any(axis=1), t


def _crossing(a: np.ndarray, b: np.ndarray, inverse: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether edges cross inside both, and the points, computed in one order (`noding._crossing`)."""
    def side(s, p):
        return np.sign((s[:, 2] - s[:, 0]) * (p[:, 1] - s[:, 1]) - (p[:, 0] - s[:, 0]) * (s[:, 3] - s[:, 1]))

    cross = (side(a, b[:, :2]) * side(a, b[:, 2:]) < 0) & (side(b, a[:, :2]) * side(b, a[:, 2:]) < 0)
    a, b = a[cross], b[cross]
    apart = np.argmax(a != b, axis=1)[:, None]
    swap = np.take_along_axis(a, apart, 1) > np.take_along_axis(b, apart, 1)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    da, db = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):  # lines that are all but parallel
        u = ((b[:, 0] - a[:, 0]) * db[:, 1] - (b[:, 1] - a[:, 1]) * db[:, 0]) / (da[:, 0] * db[:, 1] - da[:, 1] * db[:, 0])
    good = np.isfinite(u)
    cross[np.flatnonzero(cross)[~good]] = False
    return cross, np.rint((a[good, :2] + u[good, None] * da[good]) * inverse) / inverse + 0.0


def _cut(f: Faces, inverse: float) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of all edges between their cuts by the row's others, and the edge of each."""
    e, tol, n = f.ends, 1.5 / inverse, np.arange(len(f.ends))
    found = [(n, np.zeros(len(e)), e[:, :2]), (n, np.ones(len(e)), e[:, 2:])]
    for i, j in Pyramid(boxes_of(e, 1 / inverse), f.row[f.face]).pairs():
        other = (e[i] != e[j]).any(axis=1)
        i, j = i[other], j[other]
        a, b = e[i], e[j]
        free = np.ones(len(i), bool)
        for edge, on, by in ((i, a, b), (j, b, a)):
            for p in (by[:, :2], by[:, 2:]):
                hit, t = _touch(on, p, tol)
                free &= ~hit
                found.append((edge[hit], t[hit], p[hit]))
        a, b, i, j = a[free], b[free], i[free], j[free]
        cross, p = _crossing(a, b, inverse)
        for edge, on in ((i[cross], a[cross]), (j[cross], b[cross])):
            d = on[:, 2:] - on[:, :2]
            axis = (np.abs(d[:, 0]) < np.abs(d[:, 1])).astype(np.int64)[:, None]
            along = np.take_along_axis(p - on[:, :2], axis, 1) / np.take_along_axis(d, axis, 1)
            found.append((edge, along[:, 0], p))
    edge, t, p = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((p[:, 1], p[:, 0], t, edge))
    edge, p = edge[order], p[order]
    some = (edge[1:] == edge[:-1]) & (p[1:] != p[:-1]).any(axis=1)
    return np.concatenate([p[:-1], p[1:]], axis=1)[some], edge[:-1][some]


def _beside(e: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Points just left (+1) or right (-1) of the middles (`noding.beside`)."""
    d = e[:, 2:] - e[:, :2]
    step = np.maximum(1e-6, np.abs(e[:, :2]).max(axis=1) * 1e-14 / np.maximum(np.abs(d).sum(axis=1), 1e-12)) * sign
    return np.stack([(e[:, 0] + e[:, 2]) / 2 - d[:, 1] * step, (e[:, 1] + e[:, 3]) / 2 + d[:, 0] * step], axis=1)


def _covered(f: Faces, points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether faces of side `a`, and of side `b`, of a point's row cover it (`geometry.covered`)."""
    of_face, of_row = np.bincount(f.face, minlength=len(f.row)), np.bincount(f.row, minlength=f.rows)
    start, first = np.cumsum(of_face) - of_face, np.cumsum(of_row) - of_row
    box = np.full((len(f.row), 4), np.nan)  # of a face without edges: holds no point
    some, b = np.flatnonzero(of_face), boxes_of(f.ends)
    if len(some):
        box[some, :2], box[some, 2:] = np.minimum.reduceat(b[:, :2], start[some]), np.maximum.reduceat(b[:, 2:], start[some])
    in_a, in_b = np.zeros(len(points), bool), np.zeros(len(points), bool)
    for begin, end in spans(of_row[row], PAIRS):
        point, place = _spans(of_row[row[begin:end]])
        point += begin
        face = first[row[point]] + place
        p, x = points[point], box[face]
        near = (p >= x[:, :2]).all(axis=1) & (p <= x[:, 2:]).all(axis=1)
        point, face = point[near], face[near]
        for at, to in spans(of_face[face], PAIRS):
            pair, place = _spans(of_face[face[at:to]])
            k, y = start[face[at:to]][pair] + place, points[point[at:to], 1][pair]
            level = np.flatnonzero((y >= b[k, 1]) & (y <= b[k, 3]))  # the others tell nothing
            pair, k, py = pair[level], k[level], y[level]
            x1, y1, x2, y2 = f.ends[k].T
            px = points[point[at:to], 0][pair]
            side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            on = (side == 0) & (px >= b[k, 0]) & (px <= b[k, 2])
            over = ((y1 > py) != (y2 > py)) & ((side > 0) == (y2 > y1))
            inside = (np.bincount(pair[over], minlength=to - at) % 2 == 1) | (np.bincount(pair[on], minlength=to - at) > 0)
            hit, of_b = point[at:to][inside], f.is_b[face[at:to][inside]]
            in_a[hit[~of_b]] = True
            in_b[hit[of_b]] = True
    return in_a, in_b


def boundaries(rows: pa.ListArray, inverse: float, subtract: bool, own: bool = False) -> pa.ListArray:
    """Of each row the directed edges around the union of its polygons or, with `subtract`, around
    the one of side `a` without those of side `b`; with `own`, of the union's only those that
    polygons of side `a` have."""
    f = Faces(rows, inverse)
    e, edge = _cut(f, inverse) if len(f.ends) else (f.ends, f.face)
    of_b = f.is_b[f.face[edge]]
    row = f.row[f.face[edge]]
    # an edge of `a` that loses is looked at on its inside, all others on their outside
    in_a, in_b = _covered(f, _beside(e, np.where(~of_b & subtract, 1.0, -1.0)), row)
    kept = in_a & ~in_b if subtract else ~(in_a | in_b)
    if own:
        kept &= ~of_b
    e, row, of_b = e[kept], row[kept], of_b[kept]
    if subtract:
        e = np.where(of_b[:, None], e[:, [2, 3, 0, 1]], e)
    order = np.lexsort((*e.T[::-1], row))
    e, row = e[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (row[1:] != row[:-1]) | (e[1:] != e[:-1]).any(axis=1)
    e, row = e[new], row[new]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
    values = pa.StructArray.from_arrays([pa.array(c) for c in e.T], ["x1", "y1", "x2", "y2"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def batches(rows: pa.ListArray):
    """The rows, some at a time, by the numbers of their vertices."""
    at = rows.offsets
    parts = rows.values.field("parts")
    rings = parts.values.field("rings")
    for lists in (parts, rings, rings.values):
        at = lists.offsets.take(at)
    for begin, end in spans(np.diff(at.to_numpy()), EDGES):
        yield rows.slice(begin, end - begin)
