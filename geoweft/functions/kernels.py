"""The small Arrow kernels: what a row's expressions can't say. Each works on the vertices of
one result geometry; Spark partitions and shuffles the rows."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from .wkb import PART_ARROW

# Edges from which on the rows followed so far are turned back into Arrow's.
BATCH_EDGES = 20_000
# Tiles of a further round lie by this share of their size beside those of the one before.
SHIFT = 0.37


def follow_edges(edges: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Closed rings from directed edges with the inside on their left. Where several edges
    leave a vertex the sharpest left turn is taken, so rings only touch, never cross."""
    out: dict[tuple[float, float], list[int]] = {}
    for i, (x1, y1, _, _) in enumerate(edges):
        out.setdefault((x1, y1), []).append(i)
    used = [False] * len(edges)
    rings = []
    for first in range(len(edges)):
        if used[first]:
            continue
        ring, at = [], first
        while not used[at]:
            used[at] = True
            x1, y1, x2, y2 = edges[at]
            ring.append((x1, y1))
            ahead = [j for j in out.get((x2, y2), ()) if not used[j]]
            if not ahead:
                break
            if len(ahead) > 1:
                back = math.atan2(y1 - y2, x1 - x2)
                # the first one clockwise from the way back is the sharpest left turn
                ahead.sort(key=lambda j: (back - math.atan2(edges[j][3] - y2, edges[j][2] - x2)) % (2 * math.pi) or 2 * math.pi)
            at = ahead[0]
        rings.append(ring)
    return [simple for ring in rings for simple in _split_at_repeats(ring)]


def _split_at_repeats(ring):
    """A ring passing a vertex twice, as the rings it touches itself in."""
    stack, seen, done = [], {}, []
    for v in ring:
        if v in seen:
            start = seen[v]
            loop = stack[start:]
            for u in loop[1:]:
                del seen[u]
            done.append(loop)
            del stack[start + 1:]
        else:
            seen[v] = len(stack)
            stack.append(v)
    done.append(stack)
    return [r for r in done if len(r) > 2]


def signed_area(ring) -> float:
    xs, ys = np.array([v[0] for v in ring]), np.array([v[1] for v in ring])
    xs, ys = xs - xs[0], ys - ys[0]
    return float(np.sum(xs * np.roll(ys, -1) - np.roll(xs, -1) * ys)) / 2


def _inside(x, y, ring) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def straight(ring):
    """Without the vertices in the middle of a straight run (left by cutting)."""
    n = len(ring)
    kept = []
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = ring[i - 1], ring[i], ring[(i + 1) % n]
        if (bx - ax) * (cy - by) - (by - ay) * (cx - bx) != 0 or (bx - ax) * (cx - bx) + (by - ay) * (cy - by) < 0:
            kept.append(ring[i])
    return kept


def nest_rings(rings) -> list[list]:
    """Polygons ([shell, hole, …]) from rings: counter-clockwise ones are shells, each
    clockwise one a hole of the smallest shell around it."""
    sized = [(signed_area(r), r) for r in rings]
    shells = sorted(((a, [r]) for a, r in sized if a > 0), key=lambda s: s[0])
    around = Shells([(a, polygon[0]) for a, polygon in shells])
    for a, hole in sized:
        if a < 0 and (at := around.of_hole(a, hole)) is not None:
            shells[at][1].append(hole)
    return [polygon for _, polygon in shells]


class Shells:
    """Rings with their areas, smallest first."""

    def __init__(self, shells):
        self.rings = [r for _, r in shells]
        self.sizes = np.array([a for a, _ in shells])
        self.boxes = np.array([(*np.min(r, axis=0), *np.max(r, axis=0)) for r in self.rings]).reshape(-1, 4)

    def of_hole(self, area: float, hole) -> int | None:
        """The number of the smallest one around a hole."""
        # a vertex of a hole may touch its shell: ask at the middle of an edge
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        b = self.boxes
        near = (self.sizes >= -area) & (b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3])
        return next((int(i) for i in np.flatnonzero(near) if _inside(x, y, self.rings[i])), None)


def polygons_from_edges(edges: pa.Array) -> pa.Array:
    """Per row: directed edges to the polygon parts they bound. One row's edges at a time are
    Python's, as a boundary may be long and a batch hold many."""
    kind = pa.list_(PART_ARROW)
    flat = edges.flatten()
    cols = [flat.field(n).to_numpy(zero_copy_only=False) for n in ("x1", "y1", "x2", "y2")]
    ends = np.concatenate([[0], np.cumsum(np.diff(edges.offsets.to_numpy()))])
    done, waiting, size = [], [], 0
    for a, b in zip(ends, ends[1:]):
        rows = list(zip(*[c[a:b].tolist() for c in cols]))
        parts = []
        for polygon in nest_rings(follow_edges(rows)):
            rings = [r for r in map(straight, polygon) if len(r) > 2]
            if rings:
                parts.append({"dim": 2, "rings": [
                    [{"x": x, "y": y, "z": None} for x, y in r + r[:1]] for r in rings
                ]})
        waiting.append(parts)
        size += b - a
        if size > BATCH_EDGES:
            done.append(pa.array(waiting, kind))
            waiting, size = [], 0
    return pa.concat_arrays([*done, pa.array(waiting, kind)])


def closed_in_tile(edges: list[tuple[float, float, float, float]], inside) -> tuple[list[list], list[int]]:
    """Polygons ([shell, hole, …]) whose edges all begin `inside` a convex tile, and the numbers of
    the other edges that do. Given are all edges that begin or end there, so every vertex of the
    tile has its edges; a shell that lies in it has its holes there too."""
    own = [i for i, e in enumerate(edges) if inside(e[0], e[1])]
    out: dict[tuple[float, float], list[int]] = {}
    for i in own:
        out.setdefault(edges[i][:2], []).append(i)
    ahead: dict[int, int] = {}
    came = dict.fromkeys(own, 0)
    for i, (x1, y1, x2, y2) in enumerate(edges):
        if not inside(x2, y2):
            continue
        nexts = out.get((x2, y2))
        if nexts is None:
            return [], own  # an open boundary
        if len(nexts) > 1:
            back = math.atan2(y1 - y2, x1 - x2)
            # the first one clockwise from the way back is the sharpest left turn
            at = min(nexts, key=lambda j: ((back - math.atan2(edges[j][3] - y2, edges[j][2] - x2)) % (2 * math.pi) or 2 * math.pi, edges[j]))
        else:
            at = nexts[0]
        ahead[i] = at
        came[at] += 1
    if any(n != 1 for n in came.values()):
        return [], own
    walk_of: dict[int, int] = {}
    walks = []
    for first in own:
        walk, at = [], first
        while at is not None and at in came and at not in walk_of:
            walk_of[at] = len(walks)
            walk.append(at)
            at = ahead.get(at)
        walks.append(walk if walk and at == first else [])
    loops = []  # (area, ring, its walk)
    for w, walk in enumerate(walks):
        for ring in _split_at_repeats([edges[i][:2] for i in walk]) if walk else ():
            if (area := signed_area(ring)) != 0:
                loops.append((area, ring, w))
    shells = sorted((s for s in loops if s[0] > 0), key=lambda s: s[0])
    around = Shells([s[:2] for s in shells])
    holes = [(ring, w, around.of_hole(area, ring)) for area, ring, w in loops if area < 0]
    # a hole whose shell is elsewhere waits for it, with all that hangs together with it
    waiting = {w for _, w, at in holes if at is None}
    while more := {w for _, w, at in holes if at is not None and shells[at][2] in waiting} | {
            shells[at][2] for _, w, at in holes if at is not None and w in waiting}:
        if more <= waiting:
            break
        waiting |= more
    polygons = {i: [ring] for i, (_, ring, w) in enumerate(shells) if w not in waiting}
    for ring, w, at in holes:
        if w not in waiting:
            polygons[at].append(ring)
    done = {i for w, walk in enumerate(walks) if w not in waiting for i in walk}
    return list(polygons.values()), [i for i in own if i not in done]


def polygons_in_tiles(edges: pa.Array, tiles: pa.Array) -> list[pa.Array]:
    """Per row: the edges that begin or end in a tile (`x`, `y`, of a `size`, in this `turn`) to the
    polygon parts that lie in it, and the edges beginning there that bound none of them."""
    parts, rest = [], []
    for row, t in zip(edges, tiles.to_pylist()):
        size, off, place = t["size"], SHIFT * t["turn"], (t["x"], t["y"])
        flat = row.values
        rows = list(zip(*[flat.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("x1", "y1", "x2", "y2")]))
        found, left = closed_in_tile(rows, lambda x, y: (math.floor(x / size + off), math.floor(y / size + off)) == place)
        shapes = [rings for p in found if (rings := [r for r in map(straight, p) if len(r) > 2])]
        parts.append(pa.array([[
            {"dim": 2, "rings": [[{"x": x, "y": y, "z": None} for x, y in r + r[:1]] for r in rings]} for rings in shapes
        ]], pa.list_(PART_ARROW)))
        some = flat.take(pa.array(left, pa.int64()))
        rest.append(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some))
    return [pa.concat_arrays(parts), pa.concat_arrays(rest)]


def simple_loops(loops: pa.Array) -> list[list[list[dict]]]:
    """Per row: a closed walk along edges to the rings it touches itself in, without vertices
    on straight runs; the same as for edges that are followed within a row."""
    result = []
    for walk in loops.to_pylist():
        rings = [straight(r) for r in _split_at_repeats([(v["x"], v["y"]) for v in walk])]
        result.append([[{"x": x, "y": y, "z": None} for x, y in r] for r in rings if len(r) > 2])
    return result


def keep_by_distance(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas–Peucker: which vertices of a line stay."""
    n = len(xs)
    keep = np.zeros(n, bool)
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        px, py = xs[a + 1:b] - xs[a], ys[a + 1:b] - ys[a]
        size2 = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / size2, 0, 1) if size2 > 0 else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        far = int(np.argmax(d))
        if d[far] > tolerance:
            keep[a + 1 + far] = True
            stack += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def keep_by_area(xs: np.ndarray, ys: np.ndarray, tolerance: float, floor: int) -> np.ndarray:
    """Visvalingam–Whyatt with the tolerance as a length: vertices whose triangle with their
    neighbours is smaller than its square go, smallest first, down to `floor` vertices."""
    n = len(xs)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = np.ones(n, bool)

    def triangle(i):
        a, c = before[i], after[i]
        return abs((xs[i] - xs[a]) * (ys[c] - ys[a]) - (xs[c] - xs[a]) * (ys[i] - ys[a])) / 2

    import heapq
    heap = [(triangle(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    left = n
    while heap and left > floor:
        size, i = heapq.heappop(heap)
        if not alive[i] or size != triangle(i):
            continue
        if size > tolerance * tolerance:
            break
        alive[i] = False
        left -= 1
        a, c = before[i], after[i]
        after[a], before[c] = c, a
        for j in (a, c):
            if 0 < j < n - 1:
                heapq.heappush(heap, (triangle(j), j))
    return alive


def _crosses_itself(rings) -> bool:
    segs = [(*p, *q) for r in rings for p, q in zip(r, r[1:])]
    s = np.array(segs)
    x1, y1, x2, y2 = (s[:, i] for i in range(4))
    for i in range(len(s)):
        j = slice(i + 1, None)
        side1 = (x2[i] - x1[i]) * (y1[j] - y1[i]) - (x1[j] - x1[i]) * (y2[i] - y1[i])
        side2 = (x2[i] - x1[i]) * (y2[j] - y1[i]) - (x2[j] - x1[i]) * (y2[i] - y1[i])
        side3 = (x2[j] - x1[j]) * (y1[i] - y1[j]) - (x1[i] - x1[j]) * (y2[j] - y1[j])
        side4 = (x2[j] - x1[j]) * (y2[i] - y1[j]) - (x2[i] - x1[j]) * (y2[j] - y1[j])
        if np.any((side1 * side2 < 0) & (side3 * side4 < 0)):
            return True
    return False


def simplify_part(part: dict, tolerance: float) -> dict:
    """One part's rings thinned. For a polygon that would cross itself the tolerance is halved
    until it doesn't, in the end to where only vertices on a straight line go."""
    if part["dim"] == 0:
        return part
    size = max((abs(c) for ring in part["rings"] for v in ring for c in (v["x"], v["y"])), default=0.0)
    while True:
        rings = []
        for ring in part["rings"]:
            xs, ys = np.array([v["x"] for v in ring]), np.array([v["y"] for v in ring])
            if part["dim"] == 1:
                keep = keep_by_distance(xs, ys, tolerance)
            else:
                # a ring is thinned as two halves: from its start to its farthest vertex and back
                far = int(np.argmax(np.hypot(xs - xs[0], ys - ys[0])))
                keep = np.zeros(len(ring), bool)
                keep[:far + 1] = keep_by_distance(xs[:far + 1], ys[:far + 1], tolerance)
                keep[far:] |= keep_by_distance(xs[far:], ys[far:], tolerance)
                if keep.sum() < 4:
                    between = [i for i in range(1, len(ring) - 1) if not keep[i]]
                    dist = lambda i: abs((xs[far] - xs[0]) * (ys[i] - ys[0]) - (xs[i] - xs[0]) * (ys[far] - ys[0]))
                    for i in sorted(between, key=dist, reverse=True)[:4 - int(keep.sum())]:
                        keep[i] = True
            rings.append([v for v, k in zip(ring, keep) if k])
        if part["dim"] == 1 or tolerance <= size * 1e-15 or not _crosses_itself([[(v["x"], v["y"]) for v in r] for r in rings]):
            return {"dim": part["dim"], "rings": rings}
        tolerance /= 2


VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])


def _thin_arc(arc: list[tuple[float, float]], tolerance: float, floor: int) -> list[tuple[float, float]]:
    """An arc thinned the same way whichever end it is read from."""
    back = arc[::-1] < arc
    way = arc[::-1] if back else arc
    xs, ys = np.array([v[0] for v in way]), np.array([v[1] for v in way])
    kept = [v for v, k in zip(way, keep_by_area(xs, ys, tolerance, floor)) if k]
    return kept[::-1] if back else kept


def simplify_marked_ring(vertices: list[dict], tolerance: float, keep_outer: bool) -> list[dict]:
    """A ring (not repeating its first vertex) thinned between its junctions; with
    `keep_outer` the arcs only one ring runs along stay as they are."""
    points = [(v["x"], v["y"]) for v in vertices]
    joints = [i for i, v in enumerate(vertices) if v["junction"]]
    n = len(points)
    start = joints[0] if joints else points.index(min(points))
    turned = [(start + i) % n for i in range(n)] + [start]
    cuts = [i for i, at in enumerate(turned) if vertices[at]["junction"]] if joints else [0, n]
    result = []
    for a, b in zip(cuts, cuts[1:]):
        arc = [points[turned[i]] for i in range(a, b + 1)]
        outer = any(vertices[turned[i]]["rings"] == 1 for i in range(a + 1, b))
        floor = 4 if not joints or len(cuts) == 2 else 2
        result += (arc if keep_outer and outer else _thin_arc(arc, tolerance, floor))[:-1]
    if len(result) < 3:
        result = points
    return [{"x": x, "y": y, "z": None} for x, y in result + result[:1]]
