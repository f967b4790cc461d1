"""Validity and repair of polygons, many at a time, in numpy.

Pairs of edges that may meet are found down a pyramid of boxes: neighbouring edges of a ring lie
close together, so blocks of 4, 16, 64, … consecutive edges have tight boxes, and only blocks
whose boxes overlap are looked into. A ring of n edges takes about n log n steps, whatever the
lengths of its edges, and all polygons of a batch are walked down together.

A broken polygon becomes the area that its rings go around an odd number of times: edges are
cut where they meet, those that lie on each other cancel in pairs, and what is left bounds that
area. Which side is inside is told by the edges that a ray from each one's middle crosses."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernels import follow_edges, nest_rings, straight

FAN = 4
# Pairs of blocks that are looked into at a time.
PAIRS = 500_000
# Cutting is repeated while rounding to the grid makes edges meet anew, this often at most.
ROUNDS = 12


# ---- pairs of boxes ---------------------------------------------------------------

class Pyramid:
    """Boxes (rows xmin, ymin, xmax, ymax) in groups that follow each other, and the boxes of
    ever larger blocks of them."""

    def __init__(self, boxes: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(boxes), np.int64) if group is None else group
        self.levels = [(boxes, group, group)]
        while len(self.levels[-1][0]) > 1:
            below, first, last = self.levels[-1]
            at = np.arange(0, len(below), FAN)
            ends = np.minimum(at + FAN, len(below)) - 1
            joint = np.concatenate([np.minimum.reduceat(below[:, :2], at), np.maximum.reduceat(below[:, 2:], at)], axis=1)
            self.levels.append((joint, first[at], last[ends]))

    def _children(self, level: int, blocks: np.ndarray) -> np.ndarray:
        """Blocks × FAN numbers one level down; those beyond the end are -1."""
        kids = blocks[:, None] * FAN + np.arange(FAN)
        return np.where(kids < len(self.levels[level - 1][0]), kids, -1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i < j, of one group whose boxes overlap or touch, some at a time."""
        if not len(self.levels[0][0]):
            return
        start = np.zeros(1, np.int64)
        waiting = [(len(self.levels) - 1, start, start)]
        while waiting:
            level, a, b = waiting.pop()
            if level == 0:
                apart = a != b
                yield a[apart], b[apart]
                continue
            if len(a) * FAN * FAN > PAIRS and len(a) > 1:
                half = len(a) // 2
                waiting += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            ka, kb = self._children(level, a), self._children(level, b)
            a, b = np.repeat(ka, FAN, axis=1).ravel(), np.tile(kb, (1, FAN)).ravel()
            some = (a >= 0) & (b >= a)  # every pair of blocks is met in one order only
            a, b = a[some], b[some]
            boxes, first, last = self.levels[level - 1]
            some = (last[a] >= first[b]) & _overlap(boxes[a], boxes[b])
            waiting.append((level - 1, a[some], b[some]))

    def met_by(self, boxes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a box given, i) that overlap or touch, some at a time."""
        if not len(boxes) or not len(self.levels[0][0]):
            return
        waiting = [(len(self.levels) - 1, np.arange(len(boxes)), np.zeros(len(boxes), np.int64))]
        while waiting:
            level, q, a = waiting.pop()
            some = _overlap(boxes[q], self.levels[level][0][a])
            q, a = q[some], a[some]
            if level == 0:
                yield q, a
            elif len(q) * FAN > PAIRS and len(q) > 1:
                half = len(q) // 2
                waiting += [(level, q[half:], a[half:]), (level, q[:half], a[:half])]
            else:
                kids = self._children(level, a)
                q, a = np.repeat(q, FAN), kids.ravel()
                waiting.append((level - 1, q[a >= 0], a[a >= 0]))


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] <= b[:, 2]) & (b[:, 0] <= a[:, 2]) & (a[:, 1] <= b[:, 3]) & (b[:, 1] <= a[:, 3])


def boxes_of(e: np.ndarray, margin: float = 0.0) -> np.ndarray:
    return np.concatenate([np.minimum(e[:, :2], e[:, 2:]) - margin, np.maximum(e[:, :2], e[:, 2:]) + margin], axis=1)


# ---- two edges ----------------------------------------------------------------------

def _side(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Above zero where the point lies left of the edge."""
    return (e[:, 2] - e[:, 0]) * (p[:, 1] - e[:, 1]) - (p[:, 0] - e[:, 0]) * (e[:, 3] - e[:, 1])


def _relation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of edges: whether they cross inside both, run along each other, meet at all."""
    b1, b2, a1, a2 = _side(a, b[:, :2]), _side(a, b[:, 2:]), _side(b, a[:, :2]), _side(b, a[:, 2:])
    across_a, across_b = np.sign(b1) * np.sign(b2), np.sign(a1) * np.sign(a2)
    cross = (across_a < 0) & (across_b < 0)
    low, high = np.maximum(boxes_of(a)[:, :2], boxes_of(b)[:, :2]), np.minimum(boxes_of(a)[:, 2:], boxes_of(b)[:, 2:])
    along = (b1 == 0) & (b2 == 0) & ((high - low) > 0).any(axis=1) & ((high - low) >= 0).all(axis=1)
    return cross, along, (across_a <= 0) & (across_b <= 0)


# ---- validity ------------------------------------------------------------------------

class Edges:
    """The edges of an Arrow array of geometries' parts, without those of no length: their
    ends, and of each the geometry, part and ring it is of and its place in the ring."""

    def __init__(self, parts: pa.ListArray):
        rings = parts.values.field("rings")
        lines = rings.values
        xy = np.stack([lines.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1) if len(lines.values) else np.zeros((0, 2))
        of_line, of_part, of_geometry = (a.offsets.to_numpy().astype(np.int64) for a in (lines, rings, parts))
        self.dims = parts.values.field("dim").to_numpy(zero_copy_only=False)
        vertex = np.repeat(np.arange(len(of_line) - 1), np.diff(of_line))
        self.part_of_ring = np.repeat(np.arange(len(of_part) - 1), np.diff(of_part))
        self.geometry_of_part = np.repeat(np.arange(len(of_geometry) - 1), np.diff(of_geometry))
        # offsets may begin behind zero: rings and parts are counted from the first that is used
        xy = xy[of_line[0]:of_line[-1]] if len(of_line) else xy
        polygon = self.dims[self.part_of_ring][vertex] == 2 if len(vertex) else np.zeros(0, bool)
        follows = np.flatnonzero((vertex[1:] == vertex[:-1]) & (xy[1:] != xy[:-1]).any(axis=1) & polygon[1:])
        self.ends = np.concatenate([xy[follows], xy[follows + 1]], axis=1)
        self.ring = vertex[follows]
        self.part = self.part_of_ring[self.ring] if len(follows) else self.ring
        counts = np.bincount(self.ring, minlength=len(of_line) - 1)
        self.place = np.arange(len(follows)) - (np.cumsum(counts) - counts)[self.ring]
        self.edges_of_ring = counts
        sizes = np.diff(of_line)
        closed = np.zeros(len(sizes), bool)
        some = np.flatnonzero(sizes)
        starts = of_line[:-1] - of_line[0]
        closed[some] = (xy[starts[some]] == xy[starts[some] + sizes[some] - 1]).all(axis=1)
        self.ring_is_closed = closed & (sizes >= 4) & (counts >= 3)
        # what would close the rings that aren't
        open_ = np.flatnonzero(~closed & (sizes > 1))
        self.gaps = np.concatenate([xy[starts[open_] + sizes[open_] - 1], xy[starts[open_]]], axis=1)
        self.geometry_of_gap = self.geometry_of_part[self.part_of_ring[open_]] if len(open_) else open_

    def broken_parts(self) -> np.ndarray:
        """Of each part whether it is a polygon that isn't valid: a ring isn't closed or touches
        itself, or edges cross or run along each other."""
        broken = np.zeros(len(self.dims), bool)
        broken[self.part_of_ring[~self.ring_is_closed]] = True
        for i, j in Pyramid(boxes_of(self.ends), self.part).pairs():
            cross, along, meet = _relation(self.ends[i], self.ends[j])
            apart = np.abs(self.place[i] - self.place[j])
            follow = (apart == 1) | (apart == self.edges_of_ring[self.ring[i]] - 1)
            touches = meet & (self.ring[i] == self.ring[j]) & ~follow
            broken[self.part[i[cross | along | touches]]] = True
        return broken & (self.dims == 2)

    def broken_geometries(self) -> np.ndarray:
        return np.unique(self.geometry_of_part[self.broken_parts()])


# ---- repair --------------------------------------------------------------------------

def grid_inverse(ends: np.ndarray) -> float:
    """Cells per unit of the precision grid that overlay works on."""
    largest = max(1.0, float(np.abs(ends).max(initial=1.0)))
    return 10.0 ** min(12, 14 - math.ceil(math.log10(largest)))


def _odd(e: np.ndarray) -> np.ndarray:
    """Edges that lie there an odd number of times, whichever way they run, once each."""
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e = np.where(back[:, None], e[:, [2, 3, 0, 1]], e)
    e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
    each, counts = np.unique(e, axis=0, return_counts=True)
    return each[counts % 2 == 1]


def _touched(e: np.ndarray, p: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether points lie on the inside of edges, and how far along."""
    d = e[:, 2:] - e[:, :2]
    size = (d * d).sum(axis=1)
    t = ((p - e[:, :2]) * d).sum(axis=1) / size
    on = (_side(e, p) ** 2 <= tolerance * tolerance * size) & (t > 0) & (t < 1)
    return on & (p != e[:, :2]).any(axis=1) & (p != e[:, 2:]).any(axis=1), t


def _cuts(e: np.ndarray, inverse: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, how far along, point) where edges are to be cut."""
    tolerance = 1.5 / inverse
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in Pyramid(boxes_of(e, tolerance)).pairs():
        a, b = e[i], e[j]
        any_touch = np.zeros(len(i), bool)
        for edge, on, other in ((i, a, b), (j, b, a)):
            for p in (other[:, :2], other[:, 2:]):
                hit, t = _touched(on, p, tolerance)
                any_touch |= hit
                found.append((edge[hit], t[hit], p[hit]))
        cross = _relation(a, b)[0] & ~any_touch
        a, b, i, j = a[cross], b[cross], i[cross], j[cross]
        da, db = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
        t = ((b[:, 0] - a[:, 0]) * db[:, 1] - (b[:, 1] - a[:, 1]) * db[:, 0]) / (da[:, 0] * db[:, 1] - da[:, 1] * db[:, 0])
        p = np.rint((a[:, :2] + t[:, None] * da) * inverse) / inverse + 0.0
        for edge, on in ((i, a), (j, b)):
            d = on[:, 2:] - on[:, :2]
            along = ((p - on[:, :2]) * d).sum(axis=1) / (d * d).sum(axis=1)
            inner = (p != on[:, :2]).any(axis=1) & (p != on[:, 2:]).any(axis=1)
            found.append((edge[inner], along[inner], p[inner]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2)))


def noded(ends: np.ndarray) -> np.ndarray:
    """Edges that meet at ends only, each lying there an odd number of times in `ends`."""
    inverse = grid_inverse(ends)
    e = _odd(np.rint(ends * inverse) / inverse + 0.0)
    for _ in range(ROUNDS):
        edge, t, p = _cuts(e, inverse)
        if not len(edge):
            break
        n = np.arange(len(e))
        edge, t, p = np.concatenate([n, edge, n]), np.concatenate([np.zeros(len(e)), t, np.ones(len(e))]), np.concatenate([e[:, :2], p, e[:, 2:]])
        order = np.lexsort((t, edge))
        edge, p = edge[order], p[order]
        same = edge[1:] == edge[:-1]
        e = _odd(np.concatenate([p[:-1], p[1:]], axis=1)[same])
    return e


def chains(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each noded edge the chain that it is of, and whether it runs against it. Within a chain
    edges follow each other through vertices that no third edge has."""
    n = len(e)
    _, vertex = np.unique(np.concatenate([e[:, :2], e[:, 2:]]), axis=0, return_inverse=True)
    vertex = vertex.ravel()
    # at a vertex of two edges each leads to the other
    order = np.argsort(vertex, kind="stable")
    first = np.searchsorted(vertex[order], np.flatnonzero(np.bincount(vertex) == 2))
    leads = np.full(2 * n, -1)
    leads[order[first]], leads[order[first + 1]] = order[first + 1], order[first]
    leads = leads.tolist()  # from an edge's end (its beginning: number e, its end: n + e) to the other edge's
    chain, against = [-1] * n, [False] * n
    for start in range(n):
        if chain[start] >= 0:
            continue
        chain[start] = start
        for way_out in (n + start, start):  # forwards, then backwards
            at = leads[way_out]
            while at >= 0 and chain[at % n] < 0:
                k = at % n
                chain[k] = start
                # entered at its end: it runs against the chain when that is followed forwards
                against[k] = (at >= n) == (way_out >= n)
                at = leads[k if at >= n else n + k]
    return np.array(chain), np.array(against)


def _inside_on_right(e: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of some of the noded edges whether the odd area lies on their right."""
    out = np.zeros(len(some), bool)
    steep = np.abs(e[some, 3] - e[some, 1]) >= np.abs(e[some, 2] - e[some, 0])
    # a ray in the direction of x; from edges that lie rather flat one in the direction of y
    for asked, f in ((np.flatnonzero(steep), e), (np.flatnonzero(~steep), e[:, [1, 0, 3, 2]])):
        own = some[asked]
        middle = (f[own, :2] + f[own, 2:]) / 2
        rays = np.stack([middle[:, 0], middle[:, 1], np.full(len(own), np.inf), middle[:, 1]], axis=1)
        crossed = np.zeros(len(own), np.int64)
        for q, k in Pyramid(boxes_of(f)).met_by(rays):
            hit = ((f[k, 1] > middle[q, 1]) != (f[k, 3] > middle[q, 1])) & (own[q] != k)
            q, k = q[hit], k[hit]
            x1, y1, x2, y2 = f[k].T
            beyond = x1 + (middle[q, 1] - y1) * (x2 - x1) / (y2 - y1) > middle[q, 0]
            crossed += np.bincount(q[beyond], minlength=len(own))
        # an odd number: the inside is where the ray goes, right of an edge that goes up; axes
        # that are swapped turn this around
        right = (crossed % 2 == 1) == (f[own, 3] > f[own, 1])
        out[asked] = right if f is e else ~right
    return out


def inside_on_left(e: np.ndarray) -> np.ndarray:
    """Noded boundary edges turned to have the odd area on their left; one ray a chain tells."""
    if not len(e):
        return e
    chain, against = chains(e)
    length = np.abs(e[:, 2:] - e[:, :2]).sum(axis=1)
    order = np.lexsort((-length, chain))
    longest = order[np.flatnonzero(np.diff(chain[order], prepend=-1))]
    right = np.zeros(len(e), bool)
    right[chain[longest]] = _inside_on_right(e, longest) ^ against[longest]
    turned = right[chain] ^ against
    return np.where(turned[:, None], e[:, [2, 3, 0, 1]], e)


def odd_area(ends: np.ndarray) -> list[list]:
    """Polygons ([shell, hole, …] of vertices) of the area around which edges go an odd number
    of times."""
    e = noded(ends)
    rings = follow_edges([tuple(r) for r in inside_on_left(e).tolist()])
    polygons = []
    for polygon in nest_rings(rings):
        kept = [r for r in map(straight, polygon) if len(r) > 2]
        if kept:
            polygons.append(kept)
    return polygons


def mended(parts: pa.ListArray) -> list[list[dict] | None]:
    """Per geometry: None where its polygons are valid, else the parts that it is made of anew."""
    out: list[list[dict] | None] = [None] * len(parts)
    if not len(parts.values):
        return out
    edges = Edges(parts)
    of_edge = edges.geometry_of_part[edges.part]
    for g in edges.broken_geometries():
        begin, end = np.searchsorted(of_edge, [g, g + 1])
        ends = np.concatenate([edges.ends[begin:end], edges.gaps[edges.geometry_of_gap == g]])
        out[g] = [{"dim": 2, "rings": [[{"x": x, "y": y, "z": None} for x, y in r + r[:1]] for r in polygon]} for polygon in odd_area(ends)]
    return out
