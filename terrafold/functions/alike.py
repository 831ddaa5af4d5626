"""Rows of equal layout that an exact function treats alike.

Relations, validity, hulls and simplification decide by signs: how vertices compare in x and y, which way three of
them turn, and a few comparisons of lengths. Rows whose signs are equal take the same decisions, so such a function
runs once for each class of rows, and its result, said in places of vertices, holds for all of them. Signs are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa

from terrafold.functions import relate, shapes, wkb

#: Numbers of an array that are computed at once, and signs of a row at most.
CELLS, MOST = 400_000, 4096
#: Fewer rows of a layout are not dealt to classes.
FEW = 16


def _exact(xy: np.ndarray, bits: int) -> np.ndarray:
    """Rows (of finite numbers) whose coordinates are multiples of a number that their span has less than 2 ** bits of."""
    flat = xy.reshape(len(xy), -1)
    exponent = np.frexp((xy.max(axis=1) - xy.min(axis=1)).max(axis=1))[1][:, None]
    with np.errstate(over="ignore"):
        units = np.ldexp(flat, bits - exponent)
    return (units == np.rint(units)).all(axis=1) & (exponent[:, 0] < 900)


def _blocks(rows: int, width: int):
    step = max(1, CELLS // max(1, width))
    return (slice(k, k + step) for k in range(0, rows, step))


def turns(xy: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Signs of the turns of three vertices each, as shapes.orient has them."""
    out = np.zeros((len(xy), len(triples)), dtype=np.int8)
    i, j, k = triples.T
    for own in _blocks(len(xy), len(triples)):
        x, y = xy[own, :, 0], xy[own, :, 1]
        ax, ay, bx, by = x[:, i] - x[:, k], y[:, i] - y[:, k], x[:, j] - x[:, k], y[:, j] - y[:, k]
        l, r = ax * by, ay * bx
        det = l - r
        sign = np.sign(det)
        sure = np.abs(det) > 4e-16 * (np.abs(l) + np.abs(r))
        sure |= (((ax == 0) | (by == 0)) & ((ay == 0) | (bx == 0))) | _exact(xy[own], 25)[:, None]
        for row, t in np.argwhere(~sure).tolist():
            sign[row, t] = shapes.orient(*(tuple(xy[own][row, v].tolist()) for v in triples[t]))
        out[own] = sign
    return out


def circles(xy: np.ndarray, fours: np.ndarray) -> np.ndarray:
    """Signs of the determinants that say on which side of a circle through three vertices the fourth lies."""
    out = np.zeros((len(xy), len(fours)), dtype=np.int8)

    def det(x, y, all_of):
        i, j, k, d = all_of
        (ax, ay), (bx, by), (cx, cy) = ((x[:, v] - x[:, d], y[:, v] - y[:, d]) for v in (i, j, k))
        terms = ((ax * ax + ay * ay) * (bx * cy - cx * by), (bx * bx + by * by) * (cx * ay - ax * cy), (cx * cx + cy * cy) * (ax * by - bx * ay))
        return sum(terms), sum(map(abs, terms))

    for own in _blocks(len(xy), len(fours)):
        value, size = det(xy[own, :, 0], xy[own, :, 1], fours.T)
        sign = np.sign(value)
        for row, t in np.argwhere(~((np.abs(value) > 1e-13 * size) | _exact(xy[own], 12)[:, None])).tolist():
            exact = np.array([[Fraction(v) for v in c] for c in xy[own][row].T.tolist()], dtype=object)
            got = det(exact[0][None, :], exact[1][None, :], fours[t][:, None])[0][0, 0]
            sign[row, t] = (got > 0) - (got < 0)
        out[own] = sign
    return out


def order(xy: np.ndarray) -> np.ndarray:
    """How each two vertices compare in x and in y."""
    i, j = np.triu_indices(xy.shape[1], 1)
    out = np.zeros((len(xy), 2 * len(i)), dtype=np.int8)
    for own in _blocks(len(xy), len(i)):
        for k in (0, 1):
            a, b = xy[own, :, k][:, i], xy[own, :, k][:, j]
            out[own, k * len(i) : (k + 1) * len(i)] = (a > b).astype(np.int8) - (a < b)
    return out


def classes(signs: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the rows whose signs are equal."""
    raw = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(s).view(np.uint8).reshape(len(s), -1) for s in signs], axis=1))
    if not raw.shape[1]:
        return [np.arange(len(raw))]
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(raw)])
    label = fixed.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.argsort(label, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(label[by])) + 1)


def _threes(n: int) -> np.ndarray | None:
    return np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3) if math.comb(n, 3) <= MOST else None


def chains(g: wkb.Group) -> list[tuple[int, int]]:
    """Vertices [lo, hi) of each line and ring."""
    return [r for leaf in g.leaves if leaf.kind != wkb.POINT for r in leaf.rings]


def _closed(g: wkb.Group) -> np.ndarray:
    """Rows whose rings are all closed."""
    out = np.ones(len(g.rows), dtype=bool)
    for leaf in g.leaves:
        for lo, hi in leaf.rings if leaf.kind == wkb.POLYGON else []:
            out &= (g.xyz[:, lo, :2] == g.xyz[:, hi - 1, :2]).all(axis=1) if hi > lo else False
    return out


def _lines(g: wkb.Group, at: int = 0) -> tuple[list[int], list[tuple[int, int]]]:
    """Vertices without those that close a ring, and segments."""
    points, segments = [], []
    for leaf in g.leaves:
        if leaf.kind == wkb.POINT:
            points += range(at + leaf.lo, at + leaf.hi)
            continue
        for lo, hi in leaf.rings:
            ring = leaf.kind == wkb.POLYGON
            own = list(range(at + lo, at + hi - ring))
            points += own
            segments += list(zip(own, own[1:] + own[: 1 if ring and len(own) > 1 else 0], strict=False))
    return points, segments


def _segment_turns(points: list[int], segments: list[tuple[int, int]]) -> np.ndarray | None:
    if len(points) * len(segments) > 3 * MOST:
        return None
    found = sorted({tuple(sorted((i, j, k))) for i, j in segments for k in points if k != i and k != j})
    return np.array(found, dtype=np.int64).reshape(-1, 3) if len(found) <= MOST else None


# signs of each function: None where rows can't be dealt to classes; rows that take no part are given as a mask


def all_turns(g: wkb.Group) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """What a convex hull depends on."""
    if (t := _threes(g.xyz.shape[1])) is None:
        return None
    xy = g.xyz[:, :, :2]
    return np.ones(len(xy), dtype=bool), [order(xy), turns(xy, t)]


def own_turns(g: wkb.Group) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """What validity depends on."""
    if g.kind not in (wkb.POLYGON, wkb.MULTIPOLYGON) or (t := _segment_turns(*_lines(g))) is None:
        return None
    xy = g.xyz[:, :, :2]
    return _closed(g), [order(xy), turns(xy, t)]


def _sections(c: np.ndarray, tolerance: np.ndarray) -> list[np.ndarray]:
    """Of each section of a chain its vertex farthest from the section's ends, and whether that is beyond the tolerance."""
    out = []
    for i, j in combinations(range(c.shape[1]), 2):
        if j - i > 1:
            gap = shapes.gaps(c[:, j] - c[:, i], c[:, i + 1 : j] - c[:, i, None])
            out += [gap.argmax(axis=1).astype(np.int8)[:, None], (gap.max(axis=1) > tolerance)[:, None]]
    return out


def _simple(g: wkb.Group) -> bool:
    return g.kind in (wkb.LINE, wkb.POLYGON, wkb.MULTILINE, wkb.MULTIPOLYGON) and all(hi - lo <= 16 for lo, hi in chains(g))


def simplify_signs(g: wkb.Group, tolerance: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
    if not _simple(g):
        return None
    found = [s for lo, hi in chains(g) for s in _sections(g.xyz[:, lo:hi, :2], tolerance)]
    return np.ones(len(g.rows), dtype=bool), [order(g.xyz[:, :, :2]), *found]


def preserve_signs(g: wkb.Group, tolerance: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
    if not _simple(g) or (turned := all_turns(g)) is None:
        return None
    out = turned[1] + simplify_signs(g, tolerance)[1]
    rows = np.arange(len(g.rows))
    for lo, hi in chains(g):
        if hi - lo > 3:
            v = g.xyz[:, lo:hi, :2] - g.xyz[:, lo, None, :2]
            far = (v**2).sum(axis=2).argmax(axis=1)
            w = v[rows, far]
            third = np.abs(v[:, :, 0] * w[:, 1, None] - v[:, :, 1] * w[:, 0, None]).argmax(axis=1)
            out += [far.astype(np.int8)[:, None], third.astype(np.int8)[:, None]]
    return turned[0], out


def concave_signs(g: wkb.Group, ratio: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """The triangulation is the same where turns and circles are; within such rows, lengths of its edges are compared."""
    n = g.xyz.shape[1]
    if math.comb(n, 4) > MOST or (turned := all_turns(g)) is None:
        return None
    xy = g.xyz[:, :, :2]
    fours = np.array(list(combinations(range(n), 4)), dtype=np.int64).reshape(-1, 4)
    one = turned[1] + [circles(xy, fours), (ratio < 1)[:, None]]
    lengths = np.zeros((len(xy), 1 + 9 * n * n), dtype=np.int8)
    for number, own in enumerate(classes(one)):
        if len(own) < 2 or ratio[own[0]] >= 1:
            continue
        at: dict = {}
        for k, p in enumerate(map(tuple, xy[own[0]].tolist())):
            at.setdefault(p, k)
        pts = sorted(at)
        edges = sorted({tuple(sorted(e)) for e in shapes.delaunay(pts)})
        if not edges:
            continue
        points = [list(map(tuple, xy[own, at[p]].tolist())) for p in pts]
        size = np.array([list(map(math.dist, points[a], points[b])) for a, b in edges]).T
        low, high = size.min(axis=1), size.max(axis=1)
        target = low + np.maximum(ratio[own], 0.0) * (high - low)
        i, j = np.triu_indices(len(edges), 1)
        found = np.concatenate([(size <= target[:, None]).astype(np.int8), (size[:, i] > size[:, j]).astype(np.int8) - (size[:, i] < size[:, j])], axis=1)
        lengths[own, : found.shape[1]] = found
    return turned[0], [*one, lengths]


# results of a class for its rows


class Places:
    """Where a geometry made of a class's vertices has them, to be filled in for other rows."""

    def __init__(self, rows: np.ndarray, made: wkb.Geometry) -> None:
        """rows: (rows, vertices, 2), of which the first gave the geometry."""
        at: dict = {}
        for k, p in enumerate(map(tuple, rows[0].tolist())):
            at.setdefault(p, k)
        found = [at.get(p) for p in map(tuple, wkb.coords(made).tolist())]
        self.known = made[1] == 0 and None not in found
        if self.known:
            self.values = wkb.refill(wkb.write(made), made, rows[:, np.array(found, dtype=np.int64)].reshape(len(rows), -1))


def meeting(xy: np.ndarray, g: wkb.Group, p: tuple[float, float]) -> np.ndarray | None:
    """For each row of a class the point that is p in its first: a vertex, or where two segments cross; NaN where that is in doubt."""
    first = list(map(tuple, xy[0].tolist()))
    if p in first:
        return xy[:, first.index(p)] + 0.0
    ring_of = {v: n for n, (lo, hi) in enumerate(chains(g)) for v in range(lo, hi)}
    found = []
    for one, two in combinations(_lines(g)[1], 2):
        if ring_of[one[0]] != ring_of[two[0]]:  # in the order in which rings are compared
            one, two = two, one
        if relate._meet(*(first[v] for v in (*one, *two))) == [p]:
            found.append((*one, *two))
    if len(found) != 1:
        return None
    a, b, c, d = (xy[:, v] + 0.0 for v in found[0])
    (dx, dy), (ex, ey), (fx, fy) = (b - a).T, (d - c).T, (c - a).T
    t = (fx * ey - fy * ex) / (dx * ey - dy * ex)
    out = a + t[:, None] * np.stack([dx, dy], axis=1)
    for end in (a, b, c, d):
        out[(out == end).all(axis=1)] = np.nan
    return out


def relation(name: str, a: wkb.Group, b: wkb.Group, rows: np.ndarray, ia: np.ndarray, ib: np.ndarray, one: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """A relation for rows of two groups (at places ia and ib in them): values, and which are known.

    one answers for a row by the geometries themselves.
    """
    out, known = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    if wkb.COLLECTION in (a.kind, b.kind) or not a.xyz.shape[1] or not b.xyz.shape[1]:
        return out, known
    (pa_, sa), (pb, sb) = _lines(a), _lines(b, a.xyz.shape[1])
    if (t := _segment_turns(pa_ + pb, sa + sb)) is None:
        return out, known
    xy = np.concatenate([a.xyz[ia][:, :, :2], b.xyz[ib][:, :, :2]], axis=1)
    fit = np.isfinite(xy).all(axis=(1, 2)) & _closed(a)[ia] & _closed(b)[ib]
    if name != "equals":  # which holds for two without a point, whatever their boxes
        n = a.xyz.shape[1]
        apart = (xy[:, :n].min(axis=1) > xy[:, n:].max(axis=1)).any(axis=1) | (xy[:, n:].min(axis=1) > xy[:, :n].max(axis=1)).any(axis=1)
        out, known = fit & apart & (name == "disjoint"), fit & apart
    part = np.flatnonzero(fit & ~known)
    if not len(part):
        return out, known
    for own in classes([order(xy[part]), turns(xy[part], t)]):
        own = part[own]
        if len(own) > 1:
            first = [wkb.fill(g, g.xyz[i[own[0]]]) for g, i in ((a, ia), (b, ib))]
            # the order of crossings on a segment follows from the signs if a geometry's own rings don't cross
            if any(g[0] in (wkb.POLYGON, wkb.MULTIPOLYGON) and not _flat_box(g) and relate.invalid_reason(g) is not None for g in first):
                continue
            out[own], known[own] = one(int(rows[own[0]])), True
    return out, known


def _flat_box(g: wkb.Geometry) -> bool:
    """A polygon without width or height, such as the box of a point, which relations take for a point or a line."""
    return g[0] == wkb.POLYGON and len(g[2]) == 1 and bool((np.ptp(g[2][0][:, :2], axis=0) == 0).any())
