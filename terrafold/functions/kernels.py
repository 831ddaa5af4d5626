"""Accessors, boxes and measures on groups of equal layout (see wkb). Each kernel gives one value for each row."""

from __future__ import annotations

import numpy as np

from terrafold.functions.wkb import COLLECTION, LINE, MULTILINE, NAMES, POINT, POLYGON, SUFFIX, Group


def all_rows(g: Group, value) -> np.ndarray:
    return np.full(len(g.rows), value, dtype=object if value is None or isinstance(value, str) else None)


def n_dims(g: Group) -> np.ndarray:
    return all_rows(g, (2, 3, 3, 4)[g.dims])


def type_upper(g: Group) -> np.ndarray:
    return all_rows(g, NAMES[g.kind].upper() + SUFFIX[g.dims])


def type_st(g: Group) -> np.ndarray:
    return all_rows(g, "ST_" + NAMES[g.kind])


def n_points(g: Group) -> np.ndarray:
    return all_rows(g, g.xyz.shape[1])


def is_empty(g: Group) -> np.ndarray:
    return all_rows(g, g.xyz.shape[1] == 0)


def n_interior_rings(g: Group) -> np.ndarray:
    return all_rows(g, max(len(g.sample[2]) - 1, 0) if g.kind == POLYGON else None)


def is_closed(g: Group) -> np.ndarray:
    if g.kind in (LINE, MULTILINE):
        out = np.full(len(g.rows), bool(g.leaves))
        for leaf in g.leaves:
            out &= leaf.hi - leaf.lo >= 2 and (g.xyz[:, leaf.lo, :2] == g.xyz[:, leaf.hi - 1, :2]).all(axis=1)
        return out
    return all_rows(g, g.kind != COLLECTION)


def ordinate(axis: str):
    def run(g: Group) -> np.ndarray:
        at = {"x": 0, "y": 1, "z": 2 if g.dims in (1, 3) else None, "m": {2: 2, 3: 3}.get(g.dims)}[axis]
        if g.kind != POINT or at is None or not g.xyz.shape[1]:
            return all_rows(g, None)
        return g.xyz[:, 0, at]

    return run


def bounds(g: Group) -> np.ndarray:
    """(rows, 6): least x, y, z and greatest x, y, z; NaN where there are none."""
    out = np.full((len(g.rows), 6), np.nan)
    if g.xyz.shape[1]:
        out[:, 0:2], out[:, 3:5] = g.xyz[:, :, :2].min(axis=1), g.xyz[:, :, :2].max(axis=1)
        if g.dims in (1, 3):
            out[:, 2], out[:, 5] = g.xyz[:, :, 2].min(axis=1), g.xyz[:, :, 2].max(axis=1)
    return out


def _ring_sums(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled signed area and the first moments about the ring's first vertex, each row."""
    v = xy - xy[:, :1]
    a, b = v[:, :-1], v[:, 1:]
    cross = a[:, :, 0] * b[:, :, 1] - b[:, :, 0] * a[:, :, 1]
    return cross.sum(axis=1), ((a + b) * cross[:, :, None]).sum(axis=1)


def area(g: Group) -> np.ndarray:
    out = np.zeros(len(g.rows))
    for leaf in g.leaves:
        if leaf.kind == POLYGON:
            for k, (lo, hi) in enumerate(leaf.rings):
                if hi - lo > 3:
                    a = np.abs(_ring_sums(g.xyz[:, lo:hi, :2])[0]) / 2
                    out += a if k == 0 else -a
    return out


def _path(xy: np.ndarray) -> np.ndarray:
    step = np.diff(xy, axis=1)
    return np.hypot(step[:, :, 0], step[:, :, 1])


def length(g: Group) -> np.ndarray:
    out = np.zeros(len(g.rows))
    if g.kind in (LINE, MULTILINE, COLLECTION):
        for leaf in g.leaves:
            if leaf.kind == LINE and leaf.hi - leaf.lo > 1:
                out += _path(g.xyz[:, leaf.lo : leaf.hi, :2]).sum(axis=1)
    return out


def centroid(g: Group) -> np.ndarray:
    """(rows, 2): of the parts of highest dimension that have a measure."""
    n = len(g.rows)
    moment, weight = np.zeros((3, n, 2)), np.zeros((3, n))
    for leaf in g.leaves:
        xy = g.xyz[:, leaf.lo : leaf.hi, :2]
        if leaf.kind == POINT and leaf.hi > leaf.lo:
            moment[0] += xy[:, 0]
            weight[0] += 1
            continue
        for k, (lo, hi) in enumerate(leaf.rings):
            ring = g.xyz[:, lo:hi, :2]
            if hi == lo:
                continue
            if leaf.kind == POLYGON and hi - lo > 3:
                twice, first = _ring_sums(ring)
                sign = np.where(twice < 0, -1.0, 1.0) * (1 if k == 0 else -1)
                weight[2] += sign * twice / 2
                moment[2] += sign[:, None] * (first / 6 + ring[:, 0] * twice[:, None] / 2)
            step = _path(ring)
            weight[1] += step.sum(axis=1)
            moment[1] += ((ring[:, :-1] + ring[:, 1:]) / 2 * step[:, :, None]).sum(axis=1)
            moment[0] += ring[:, 0]
            weight[0] += 1
    out = np.full((n, 2), np.nan)
    for d in (0, 1, 2):
        ok = weight[d] > 0
        out[ok] = moment[d][ok] / weight[d][ok, None]
    return out
