"""Processing of single geometries: hull, envelope, interior point, simplification, line merge, distance."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np

from terrafold.functions.wkb import COLLECTION, LINE, MULTILINE, MULTIPOLYGON, POINT, POLYGON, Geometry, box_geometry, coords, is_empty, leaves

Point = tuple[float, float]


def orient(a: Point, b: Point, c: Point) -> int:
    """Sign of the turn a, b, c; exact."""
    l, r = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = l - r
    if abs(det) > 4e-16 * (abs(l) + abs(r)):
        return 1 if det > 0 else -1
    if not all(map(math.isfinite, (*a, *b, *c))):
        return 0
    from fractions import Fraction as F

    ax, ay, bx, by, cx, cy = map(F, (*a, *b, *c))
    exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (exact > 0) - (exact < 0)


def hull_ring(xy: np.ndarray) -> list[Point]:
    """Vertices of the convex hull, counter-clockwise, not closed."""
    pts = sorted(set(map(tuple, xy.tolist())))
    if len(pts) < 3:
        return pts

    def half(points) -> list[Point]:
        out: list[Point] = []
        for p in points:
            while len(out) > 1 and orient(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(reversed(pts))
    return ring if len(ring) > 2 else [pts[0], pts[-1]]


def _shape(ring: list[Point]) -> Geometry:
    if not ring:
        return (COLLECTION, 0, [])
    if len(ring) == 1:
        return (POINT, 0, np.array(ring))
    if len(ring) == 2:
        return (LINE, 0, np.array(ring))
    return (POLYGON, 0, [np.array([*ring, ring[0]])])


def convex_hull(g: Geometry) -> Geometry:
    """A polygon; a line or a point where the vertices span no area."""
    return _shape(hull_ring(coords(g)))


def oriented_envelope(g: Geometry) -> Geometry:
    """The least rectangle of any rotation; a line or a point where the vertices span no area."""
    ring = hull_ring(coords(g))
    if len(ring) < 3:
        return _shape(ring)
    p = np.array(ring)
    edge = np.roll(p, -1, axis=0) - p
    unit = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    along, across = p @ unit.T, p @ np.stack([-unit[:, 1], unit[:, 0]])
    size = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    k = int(size.argmin())
    u, v = unit[k], np.array([-unit[k, 1], unit[k, 0]])
    a0, a1, b0, b1 = along[:, k].min(), along[:, k].max(), across[:, k].min(), across[:, k].max()
    corners = [a * u + b * v for a, b in ((a0, b0), (a1, b0), (a1, b1), (a0, b1), (a0, b0))]
    return (POLYGON, 0, [np.array(corners)])


def _in_circle(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether d lies inside the circle through the counter-clockwise a, b, c; exact where floats can't tell."""

    def det(one):
        rows = []
        for p in (a, b, c):
            x, y = one(p[0]) - one(d[0]), one(p[1]) - one(d[1])
            rows.append((x, y, x * x + y * y))
        (ax, ay, aa), (bx, by, bb), (cx, cy, cc) = rows
        terms = (aa * (bx * cy - cx * by), bb * (cx * ay - ax * cy), cc * (ax * by - bx * ay))
        return sum(terms), sum(map(abs, terms))

    value, size = det(float)
    if abs(value) > 1e-13 * size:
        return value > 0
    from fractions import Fraction

    return det(Fraction)[0] > 0


def delaunay(pts: list[Point]) -> dict[tuple[int, int], int]:
    """Triangles of sorted distinct points: each directed edge, counter-clockwise, with its third corner. Empty if all lie on a line."""
    third: dict[tuple[int, int], int] = {}
    k = next((i for i in range(2, len(pts)) if orient(pts[0], pts[1], pts[i])), None)
    if k is None:
        return third

    def add(a: int, b: int, c: int) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    left = orient(pts[0], pts[1], pts[k]) > 0
    for i in range(k - 1):
        add(*((i, i + 1, k) if left else (i + 1, i, k)))
    ring = [*range(k), k] if left else [*range(k - 1, -1, -1), k]
    for p in range(k + 1, len(pts)):
        n = len(ring)
        seen = [orient(pts[ring[i]], pts[ring[(i + 1) % n]], pts[p]) < 0 for i in range(n)]
        for i in range(n):
            if seen[i]:
                add(ring[(i + 1) % n], ring[i], p)
        start = next(i for i in range(n) if seen[i] and not seen[i - 1])
        ring = ring[start:] + ring[:start]
        count = sum(seen)
        ring = [ring[0], p, *ring[count:]]
    todo = list(third)
    while todo:
        a, b = todo.pop()
        c, d = third.get((a, b)), third.get((b, a))
        if c is None or d is None or not _in_circle(pts[a], pts[b], pts[c], pts[d]):
            continue
        for e in ((a, b), (b, c), (c, a), (b, a), (a, d), (d, b)):
            third.pop(e, None)
        add(c, a, d)
        add(d, b, c)
        todo += [(a, d), (d, b), (b, c), (c, a)]
    return third


def concave_hull(g: Geometry, ratio: float) -> Geometry:
    """The convex hull worn down from its longest edges on, over the Delaunay triangles, as far as all vertices stay inside.

    ratio: 1 keeps the convex hull, 0 wears down as far as it goes; edges over the length at this share between the shortest
    and the longest are opened.
    """
    pts = sorted(set(map(tuple, coords(g).tolist())))
    third = delaunay(pts) if ratio < 1 else {}
    if not third:
        return convex_hull(g)
    size = lambda e: math.dist(pts[e[0]], pts[e[1]])
    lengths = [size(e) for e in third]
    target = min(lengths) + max(ratio, 0.0) * (max(lengths) - min(lengths))
    border = {e for e in third if (e[1], e[0]) not in third}
    outer = {a for a, _ in border}
    heap = [(-size(e), e) for e in border]
    heapq.heapify(heap)
    while heap:
        minus, (a, b) = heapq.heappop(heap)
        if -minus <= target:
            break
        c = third[a, b]
        if c in outer:
            continue
        outer.add(c)
        for e in ((a, b), (b, c), (c, a)):
            del third[e]
        border.remove((a, b))
        for u, v in ((c, b), (a, c)):
            border.add((u, v))
            heapq.heappush(heap, (-size((u, v)), (u, v)))
    after = dict(border)
    ring = [min(after)]
    while (n := after[ring[-1]]) != ring[0]:
        ring.append(n)
    return (POLYGON, 0, [np.array([pts[i] for i in [*ring, ring[0]]])])


def envelope(g: Geometry) -> Geometry:
    """The bounding box as a polygon; a line or a point where it has no area."""
    xy = coords(g)
    if not len(xy):
        return g
    (x0, y0), (x1, y1) = xy.min(axis=0).tolist(), xy.max(axis=0).tolist()
    if x0 == x1 and y0 == y1:
        return (POINT, 0, np.array([(x0, y0)]))
    if x0 == x1 or y0 == y1:
        return (LINE, 0, np.array([(x0, y0), (x1, y1)]))
    return box_geometry(x0, y0, x1, y1)


def point_on_surface(g: Geometry) -> Geometry:
    """Middle of the widest section of a mid-height scan line; for lines and points the vertex nearest the middle."""
    best: tuple[float, Point] | None = None
    for leaf in leaves(g):
        if leaf[0] != POLYGON or not leaf[2] or not len(leaf[2][0]):
            continue
        rings = [r[:, :2] for r in leaf[2] if len(r)]
        ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
        shell = rings[0][:, 1]
        mid = (shell.min() + shell.max()) / 2
        below, above = ys[ys <= mid], ys[ys > mid]
        y = (below[-1] + above[0]) / 2 if len(below) and len(above) else mid
        xs = []
        for r in rings:
            a, b = r[:-1], r[1:]
            hit = (a[:, 1] > y) != (b[:, 1] > y)
            a, b = a[hit], b[hit]
            xs += (a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).tolist()
        xs.sort()
        for x0, x1 in zip(xs[::2], xs[1::2], strict=False):
            if x1 > x0 and (best is None or x1 - x0 > best[0]):
                best = (x1 - x0, ((x0 + x1) / 2, float(y)))
    if best is not None:
        return (POINT, 0, np.array([best[1]]))
    xy = coords(g)
    if not len(xy):
        return (POINT, 0, np.zeros((0, 2)))
    lines = [leaf[2][:, :2] for leaf in leaves(g) if leaf[0] == LINE and len(leaf[2])]
    inner = [p for c in lines for p in c[1:-1].tolist()]
    pool = np.array(inner) if inner else np.array([p for c in lines for p in (c[0], c[-1])]) if lines else xy
    if lines:
        step = [np.hypot(*np.diff(c, axis=0).T) for c in lines]
        total = sum(s.sum() for s in step)
        middle = sum(((c[:-1] + c[1:]) / 2 * s[:, None]).sum(axis=0) for c, s in zip(lines, step, strict=True)) / total if total else xy.mean(axis=0)
    else:
        middle = xy.mean(axis=0)
    return (POINT, 0, pool[((pool - middle) ** 2).sum(axis=1).argmin()][None, :].copy())


def gaps(d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of points v from the segment from 0 to d; v has one axis more than d."""
    dx, dy = d[..., None, 0], d[..., None, 1]
    size = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(size == 0, 0.0, np.clip((v[..., 0] * dx + v[..., 1] * dy) / size, 0, 1))
    return np.hypot(v[..., 0] - t * dx, v[..., 1] - t * dy)


def _keep_dp(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that Douglas-Peucker keeps."""
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        gap = gaps(xy[j] - xy[i], xy[i + 1 : j] - xy[i])
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def _keep_vw(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices that Visvalingam-Whyatt keeps: triangles under the tolerance go, the least first."""
    n = len(xy)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    size = lambda i: abs((xy[i, 0] - xy[before[i], 0]) * (xy[after[i], 1] - xy[before[i], 1]) - (xy[after[i], 0] - xy[before[i], 0]) * (xy[i, 1] - xy[before[i], 1])) / 2
    now = {i: size(i) for i in range(1, n - 1)}
    heap = [(s, i) for i, s in now.items()]
    heapq.heapify(heap)
    keep = np.ones(n, dtype=bool)
    while heap:
        s, i = heapq.heappop(heap)
        if not keep[i] or now.get(i) != s:
            continue
        if s > tolerance:
            break
        keep[i] = False
        after[before[i]], before[after[i]] = after[i], before[i]
        for j in (before[i], after[i]):
            if 0 < j < n - 1:
                now[j] = max(s, size(j))
                heapq.heappush(heap, (now[j], j))
    return keep


def _map_lines(g: Geometry, line, ring) -> Geometry:
    """Lines and rings replaced by functions of their XY coordinates; other geometries as they are."""
    kind, dims, data = g
    if kind == LINE:
        return (LINE, 0, line(data[:, :2]) if len(data) else np.zeros((0, 2)))
    if kind == POLYGON:
        rings = [ring(r[:, :2]) for r in data if len(r)]
        if not rings or rings[0] is None:
            return (POLYGON, 0, [])
        return (POLYGON, 0, [r for r in rings if r is not None])
    if kind in (MULTILINE, MULTIPOLYGON):
        parts = [_map_lines(p, line, ring) for p in data]
        return (kind, 0, [p for p in parts if len(p[2])])
    return g


def simplify(g: Geometry, tolerance: float) -> Geometry:
    """Douglas-Peucker; rings that lose their area go."""

    def ring(c: np.ndarray) -> np.ndarray | None:
        out = c[_keep_dp(c, tolerance)] if len(c) > 2 else c
        return out if len(out) > 3 else None

    return _map_lines(g, lambda c: c[_keep_dp(c, tolerance)] if len(c) > 2 else c, ring)


def simplify_vw(g: Geometry, tolerance: float) -> Geometry:
    def ring(c: np.ndarray) -> np.ndarray | None:
        out = c[_keep_vw(c, tolerance)] if len(c) > 2 else c
        return out if len(out) > 3 else None

    return _map_lines(g, lambda c: c[_keep_vw(c, tolerance)] if len(c) > 2 else c, ring)


def _crosses(a: Point, b: Point, segments: np.ndarray) -> bool:
    """Whether a-b meets one of the segments other than at a common end."""
    if not len(segments):
        return False
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    near = ((np.minimum(segments[:, 0], segments[:, 1]) <= hi) & (np.maximum(segments[:, 0], segments[:, 1]) >= lo)).all(axis=1)
    for p, q in segments[near].tolist():
        p, q = tuple(p), tuple(q)
        if {p, q} == {a, b}:
            return True
        o1, o2, o3, o4 = orient(a, b, p), orient(a, b, q), orient(p, q, a), orient(p, q, b)
        common = {p, q} & {a, b}
        if common:
            other = (q if p in common else p), (b if a in common else a)
            if o1 == o2 == 0 and (other[0][0] - next(iter(common))[0]) * (other[1][0] - next(iter(common))[0]) + (other[0][1] - next(iter(common))[1]) * (other[1][1] - next(iter(common))[1]) > 0:
                return True
            continue
        if o1 * o2 <= 0 and o3 * o4 <= 0:
            return True
    return False


def simplify_preserve(g: Geometry, tolerance: float) -> Geometry:
    """Douglas-Peucker that flattens a section only if the new segment meets no other part; rings keep four vertices."""
    chains: list[np.ndarray] = []
    for leaf in leaves(g):
        if leaf[0] != POINT:
            chains += [c[:, :2] for c in (leaf[2] if leaf[0] == POLYGON else [leaf[2]])]
    live: list[dict[int, int]] = [{i: i + 1 for i in range(len(c) - 1)} for c in chains]
    points = [list(map(tuple, c.tolist())) for c in chains]

    def others(k: int, i: int, j: int) -> np.ndarray:
        got = [(points[m][s], points[m][e]) for m, links in enumerate(live) for s, e in links.items() if m != k or e <= i or s >= j]
        return np.array(got, dtype=np.float64).reshape(-1, 2, 2)

    out = []
    for k, c in enumerate(chains):
        n = len(c)
        closed = n > 3 and points[k][0] == points[k][-1]
        stack = [(0, n - 1)]
        if closed:  # keep a triangle at least: split at the vertex farthest from the start, then again
            far = int(((c - c[0]) ** 2).sum(axis=1).argmax())
            third = int(np.abs((c[:, 0] - c[0, 0]) * (c[far, 1] - c[0, 1]) - (c[:, 1] - c[0, 1]) * (c[far, 0] - c[0, 0])).argmax())
            cuts = sorted({0, far, third, n - 1})
            stack = list(zip(cuts[:-1], cuts[1:], strict=True))
        while stack:
            i, j = stack.pop()
            if j - i < 2:
                continue
            gap = gaps(c[j] - c[i], c[i + 1 : j] - c[i])
            m = i + 1 + int(gap.argmax())
            if gap[m - i - 1] <= tolerance and points[k][i] != points[k][j] and not _crosses(points[k][i], points[k][j], others(k, i, j)):
                for s in range(i, j):
                    live[k].pop(s, None)
                live[k][i] = j
            else:
                stack += [(i, m), (m, j)]
        out.append(c[sorted({0, n - 1, *live[k], *live[k].values()})] if n else c)
    it = iter(out)
    return _map_lines(g, lambda c: next(it), lambda c: next(it))


def line_merge(g: Geometry, directed: bool = False) -> Geometry:
    """Lines sewn together where exactly two ends meet; a polygon's rings count as lines."""
    if is_empty(g):
        return g
    lines: list[list[Point]] = []
    for leaf in leaves(g):
        for c in (leaf[2] if leaf[0] == POLYGON else [leaf[2]] if leaf[0] == LINE else []):
            line = []
            for p in map(tuple, c[:, :2].tolist()):
                if not line or line[-1] != p:
                    line.append(p)
            if len(line) > 1:
                lines.append(line)
    if not lines:
        return (COLLECTION, 0, [])
    at: dict[Point, list[tuple[int, int]]] = defaultdict(list)  # (line, 0 for its start or 1 for its end)
    for i, line in enumerate(lines):
        at[line[0]].append((i, 0))
        at[line[-1]].append((i, 1))

    def follow(i: int, end: int) -> tuple[int, int] | None:
        """The line that goes on from an end of line i, and the end at which it is entered."""
        point = lines[i][-1 if end else 0]
        meet = at[point]
        if len(meet) != 2 or meet[0][0] == meet[1][0]:
            return None
        j, side = meet[0] if meet[1] == (i, end) else meet[1]
        if directed and side == end:
            return None
        return j, side

    used: set[int] = set()
    merged: list[list[Point]] = []

    def walk(i: int, end: int) -> list[tuple[int, int]]:
        """Lines and the end by which each is left, from line i on."""
        chain = [(i, end)]
        seen = {i}
        while (step := follow(*chain[-1])) is not None and step[0] not in seen:
            seen.add(step[0])
            chain.append((step[0], 1 - step[1]))
        return chain

    def emit(chain: list[tuple[int, int]]) -> None:
        used.update(i for i, _ in chain)
        forward = sum(1 if end else -1 for _, end in chain)
        if forward < 0:
            chain = [(i, 1 - end) for i, end in reversed(chain)]
        out: list[Point] = []
        for i, end in chain:
            part = lines[i] if end else lines[i][::-1]
            out += part if not out else part[1:]
        merged.append(out)

    # chains start at nodes of another degree than two, in order; then rings are left
    for point in sorted(at):
        for i, end in at[point]:
            if i not in used and follow(i, end) is None:
                emit(walk(i, 1 - end))
    for i in range(len(lines)):
        if i not in used:
            emit(walk(i, 1))
    if len(merged) == 1:
        return (LINE, 0, np.array(merged[0]))
    return (MULTILINE, 0, [(LINE, 0, np.array(m)) for m in merged])


def _segments(g: Geometry) -> np.ndarray:
    got = [np.stack([c[:-1, :2], c[1:, :2]], axis=1) for leaf in leaves(g) if leaf[0] != POINT for c in (leaf[2] if leaf[0] == POLYGON else [leaf[2]]) if len(c) > 1]
    return np.concatenate(got) if got else np.zeros((0, 2, 2))


def _point_segments(p: np.ndarray, s: np.ndarray) -> float:
    """Least distance of points to segments, in blocks."""
    best = math.inf
    for k in range(0, len(p), max(1, 200_000 // max(1, len(s)))):
        q = p[k : k + max(1, 200_000 // max(1, len(s)))]
        d = s[:, 1] - s[:, 0]
        size = (d * d).sum(axis=1)
        v = q[:, None] - s[None, :, 0]
        t = np.clip((v * d).sum(axis=2) / np.where(size > 0, size, 1), 0, 1)
        gap = v - t[:, :, None] * d
        best = min(best, float(np.hypot(gap[:, :, 0], gap[:, :, 1]).min()))
    return best


def distance(a: Geometry, b: Geometry) -> float | None:
    """Least distance; nothing if one of them is empty."""
    from terrafold.functions.relate import intersects

    pa, pb = coords(a), coords(b)
    if not len(pa) or not len(pb):
        return None
    if intersects(a, b):
        return 0.0
    sa, sb = _segments(a), _segments(b)
    best = math.inf
    if len(sb):
        best = min(best, _point_segments(pa, sb))
    if len(sa):
        best = min(best, _point_segments(pb, sa))
    lone = lambda g: np.concatenate([c for leaf in leaves(g) if leaf[0] == POINT or len(leaf[2]) == 1 for c in [leaf[2][:, :2] if leaf[0] != POLYGON else np.zeros((0, 2))]] or [np.zeros((0, 2))])
    la, lb = lone(a), lone(b)
    if len(la) and len(lb):
        gap = la[:, None] - lb[None]
        best = min(best, float(np.hypot(gap[:, :, 0], gap[:, :, 1]).min()))
    return best
