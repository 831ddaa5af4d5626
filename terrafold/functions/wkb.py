"""Well-known binary: single geometries as small tuples, and whole columns grouped by layout.

A geometry is (kind, dims, data): kind 1-7 as in WKB, dims 0 XY, 1 XYZ, 2 XYM, 3 XYZM. data is an (n, d) array
for points (n is 0 or 1) and lines, a list of such arrays for polygons, a list of geometries otherwise.

Columns hold many geometries of few layouts. Rows with equal headers (types and counts) form a group whose
coordinates are one (rows, points, d) array, so kernels work on all rows of a group at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
SUFFIX = ("", "Z", "M", "ZM")
WIDTH = (2, 3, 3, 4)
_CHILD = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}
Geometry = tuple  # (kind, dims, data)


def _read(b: bytes, at: int) -> tuple[Geometry, int]:
    if len(b) < at + 5:
        raise ValueError("WKB ends early")
    e = "<" if b[at] == 1 else ">" if b[at] == 0 else None
    if e is None:
        raise ValueError(f"WKB byte order {b[at]} is unknown")
    (code,) = struct.unpack_from(e + "I", b, at + 1)
    at += 5
    dims = (1 if code & 0x80000000 else 0) | (2 if code & 0x40000000 else 0)
    if code & 0x20000000:
        at += 4
    code &= 0x1FFFFFFF
    kind = code % 1000
    dims |= code // 1000
    if kind not in NAMES or dims > 3:
        raise ValueError(f"WKB type {code} is not supported")
    d = WIDTH[dims]

    def coords(n: int) -> np.ndarray:
        nonlocal at
        if len(b) < at + 8 * d * n:
            raise ValueError("WKB ends early")
        got = np.frombuffer(b, dtype=e + "f8", count=n * d, offset=at).reshape(n, d).astype(np.float64)
        at += 8 * d * n
        return got

    def count() -> int:
        nonlocal at
        if len(b) < at + 4:
            raise ValueError("WKB ends early")
        (n,) = struct.unpack_from(e + "I", b, at)
        at += 4
        return n

    if kind == POINT:
        c = coords(1)
        return (kind, dims, c[:0] if np.isnan(c[0, :2]).all() else c), at
    if kind == LINE:
        return (kind, dims, coords(count())), at
    if kind == POLYGON:
        return (kind, dims, [coords(count()) for _ in range(count())]), at
    parts = []
    for _ in range(count()):
        part, at = _read(b, at)
        parts.append(part)
    return (kind, dims, parts), at


def read(b: bytes) -> Geometry:
    """The geometry of ISO or extended WKB in either byte order; an SRID is dropped."""
    geom, at = _read(b, 0)
    if at != len(b):
        raise ValueError("bytes after the WKB's end")
    return geom


def head(kind: int, dims: int, *counts: int) -> bytes:
    """Byte order, type and counts, as they come before the numbers of a point, a line or a polygon of one ring."""
    return struct.pack(f"<BI{len(counts)}I", 1, kind + 1000 * dims, *counts)


def write(g: Geometry) -> bytes:
    """Little-endian ISO WKB."""
    kind, dims, data = g
    head = struct.pack("<BI", 1, kind + 1000 * dims)
    if kind == POINT:
        c = data if len(data) else np.full((1, WIDTH[dims]), np.nan)
        return head + np.ascontiguousarray(c, dtype="<f8").tobytes()
    if kind == LINE:
        return head + struct.pack("<I", len(data)) + np.ascontiguousarray(data, dtype="<f8").tobytes()
    if kind == POLYGON:
        return head + struct.pack("<I", len(data)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, dtype="<f8").tobytes() for r in data)
    return head + struct.pack("<I", len(data)) + b"".join(write(p) for p in data)


def is_empty(g: Geometry) -> bool:
    kind, _, data = g
    if kind in (POINT, LINE):
        return not len(data)
    if kind == POLYGON:
        return not any(len(r) for r in data)
    return all(is_empty(p) for p in data)


def leaves(g: Geometry) -> Iterator[Geometry]:
    """Points, lines and polygons of a geometry."""
    if g[0] <= POLYGON:
        yield g
    else:
        for p in g[2]:
            yield from leaves(p)


def coords(g: Geometry) -> np.ndarray:
    """All vertices, x and y."""
    got = [c[:, :2] for leaf in leaves(g) for c in (leaf[2] if leaf[0] == POLYGON else [leaf[2]])]
    return np.concatenate(got) if got else np.zeros((0, 2))


def box_geometry(x0: float, y0: float, x1: float, y1: float) -> Geometry:
    return (POLYGON, 0, [np.array([(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)])])


@dataclass
class Leaf:
    """Of a layout: a point, line or polygon with its rows' coordinates [lo, hi) and ring edges."""

    kind: int
    lo: int
    hi: int
    rings: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Group:
    """Rows of one layout: rows are their places in the column, xyz their coordinates (rows, points, d)."""

    rows: np.ndarray
    kind: int
    dims: int
    leaves: list[Leaf]
    top: list[tuple[int, int]]  # leaves [a, b) of each direct part
    xyz: np.ndarray
    sample: Geometry


def _layout(g: Geometry) -> tuple[list[Leaf], list[tuple[int, int]]]:
    out: list[Leaf] = []
    at = 0
    for leaf in leaves(g):
        lo = at
        rings = []
        for c in leaf[2] if leaf[0] == POLYGON else [leaf[2]]:
            rings.append((at, at + len(c)))
            at += len(c)
        out.append(Leaf(leaf[0], lo, at, rings))
    top, n = [], 0
    for p in g[2] if g[0] > POLYGON else []:
        k = sum(1 for _ in leaves(p))
        top.append((n, n + k))
        n += k
    return out, top


def _mask(g: Geometry, size: int) -> np.ndarray:
    """Which bytes of the little-endian ISO form are coordinates; points without any count as coordinates."""
    mask = np.zeros(size, dtype=bool)
    at = 0

    def walk(g: Geometry) -> None:
        nonlocal at
        kind, dims, data = g
        at += 5
        if kind == POINT:
            mask[at : at + 8 * WIDTH[dims]] = True
            at += 8 * WIDTH[dims]
        elif kind == LINE:
            at += 4
            mask[at : at + 8 * data.size] = True
            at += 8 * data.size
        elif kind == POLYGON:
            at += 4
            for r in data:
                at += 4
                mask[at : at + 8 * r.size] = True
                at += 8 * r.size
        else:
            at += 4
            for p in data:
                walk(p)

    walk(g)
    return mask


def as_geometries(column: pa.Array) -> list[Geometry | None]:
    """One by one, from WKB, WKT, box or point structs; equal values are read once."""
    from terrafold.functions import wkt

    seen: dict = {}
    out = []
    kind = column.type
    if pa.types.is_null(kind):
        return [None] * len(column)
    if pa.types.is_struct(kind):
        for v in column.to_pylist():
            out.append(_from_struct(v))
        return out
    text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    for v in column.to_pylist():
        if v is None:
            out.append(None)
            continue
        if v not in seen:
            seen[v] = wkt.parse(v) if text else read(v)
        out.append(seen[v])
    return out


def _from_struct(v: dict | None) -> Geometry | None:
    if v is None:
        return None
    if "xmin" in v:
        if any(v[k] is None for k in ("xmin", "ymin", "xmax", "ymax")):
            return None
        return box_geometry(v["xmin"], v["ymin"], v["xmax"], v["ymax"])
    if "x" in v and "y" in v:
        z, m = v.get("z"), v.get("m")
        values = [v["x"], v["y"], *([z] if "z" in v else []), *([m] if "m" in v else [])]
        return None if any(c is None for c in values) else (POINT, ("z" in v) + 2 * ("m" in v), np.array([values], dtype=np.float64))
    raise ValueError("a struct is neither a box nor a point")


def groups(column: pa.Array) -> Iterator[Group]:
    """The column's non-null rows, by layout."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        rows = np.flatnonzero(np.asarray(column.is_valid()))
        if not len(rows):
            return
        offsets = np.frombuffer(column.buffers()[1], dtype="<i8", count=column.offset + len(column) + 1)[column.offset :]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        size = (offsets[1:] - offsets[:-1])[rows]
        for n in np.unique(size).tolist():
            own = rows[size == n]
            if not n:
                raise ValueError("WKB ends early")
            raw = data[offsets[own][:, None] + np.arange(n)]
            while len(own):
                first = raw[0].tobytes()
                g = read(first)
                if write(g) != first and not (first[0] == 1 and len(write(g)) == n and _same_nan(first, write(g))):
                    yield _single(int(own[0]), g)  # another byte order or an extended form
                    own, raw = own[1:], raw[1:]
                    continue
                mask = _mask(g, n)
                same = (raw[:, ~mask] == raw[0, ~mask]).all(axis=1)
                yield from _grouped(own[same], g, np.ascontiguousarray(raw[same][:, mask]))
                own, raw = own[~same], raw[~same]
        return
    for i, g in enumerate(as_geometries(column)):
        if g is not None:
            yield _single(i, g)


def _same_nan(a: bytes, b: bytes) -> bool:
    """Forms that differ in the bits of NaN only."""
    return read(a)[0] == read(b)[0] and len(a) == len(b)


def _flat(g: Geometry) -> np.ndarray:
    got = [c for leaf in leaves(g) for c in (leaf[2] if leaf[0] == POLYGON else [leaf[2]])]
    return np.concatenate(got) if got else np.zeros((0, WIDTH[g[1]]))


def _single(row: int, g: Geometry) -> Group:
    own, top = _layout(g)
    return Group(np.array([row]), g[0], g[1], own, top, _flat(g)[None, :, :], g)


def _grouped(rows: np.ndarray, g: Geometry, raw: np.ndarray) -> Iterator[Group]:
    d = WIDTH[g[1]]
    if any(WIDTH[leaf[1]] != d for leaf in leaves(g)):
        for r, b in zip(rows.tolist(), raw, strict=True):
            yield _single(r, _refill(g, b.tobytes()))
        return
    xyz = raw.view("<f8").reshape(len(rows), -1, d)
    if any(leaf[0] == POINT for leaf in leaves(g)):
        # an empty point is one without numbers; such rows have a layout of their own
        slots, at = [], 0
        for leaf in leaves(g):
            n = 1 if leaf[0] == POINT else sum(len(r) for r in leaf[2]) if leaf[0] == POLYGON else len(leaf[2])
            slots += [at] if leaf[0] == POINT else []
            at += n
        empty = np.isnan(xyz[:, slots, :2]).all(axis=2)
        for pattern in np.unique(empty, axis=0):
            own = (empty == pattern).all(axis=1)
            keep = np.ones(xyz.shape[1], dtype=bool)
            keep[np.array(slots)[pattern]] = False
            shape = _without(g, iter(pattern.tolist()))
            leaf, top = _layout(shape)
            yield Group(rows[own], g[0], g[1], leaf, top, xyz[own][:, keep], shape)
        return
    own, top = _layout(g)
    yield Group(rows, g[0], g[1], own, top, xyz, g)


def _without(g: Geometry, empty: Iterator[bool]) -> Geometry:
    kind, dims, data = g
    if kind == POINT:
        return (kind, dims, np.zeros((0, WIDTH[dims])) if next(empty) else np.zeros((1, WIDTH[dims])))
    return g if kind <= POLYGON else (kind, dims, [_without(p, empty) for p in data])


def _refill(g: Geometry, raw: bytes) -> Geometry:
    """g's layout with other coordinates."""
    at = 0

    def walk(g: Geometry) -> Geometry:
        nonlocal at
        kind, dims, data = g

        def take(n: int) -> np.ndarray:
            nonlocal at
            c = np.frombuffer(raw, dtype="<f8", count=n * WIDTH[dims], offset=at).reshape(n, WIDTH[dims])
            at += 8 * n * WIDTH[dims]
            return c

        if kind == POINT:
            c = take(1)
            return (kind, dims, c[:0] if np.isnan(c[0, :2]).all() else c)
        if kind == LINE:
            return (kind, dims, take(len(data)))
        if kind == POLYGON:
            return (kind, dims, [take(len(r)) for r in data])
        return (kind, dims, [walk(p) for p in data])

    return walk(g)


def points_to_wkb(columns: list[np.ndarray], dims: int, valid: np.ndarray) -> pa.Array:
    """Fixed-size point records."""
    d = WIDTH[dims]
    out = np.empty((len(valid), 5 + 8 * d), dtype=np.uint8)
    out[:, :5] = np.frombuffer(struct.pack("<BI", 1, POINT + 1000 * dims), dtype=np.uint8)
    xyz = np.stack([np.asarray(c, dtype="<f8") for c in columns], axis=1)
    out[:, 5:] = np.ascontiguousarray(xyz).view(np.uint8).reshape(len(valid), 8 * d)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(out.shape[1]), len(valid), [pa.array(valid).buffers()[1], pa.py_buffer(out.tobytes())]) if len(valid) else pa.array([], pa.binary(out.shape[1]))
    return fixed.cast(pa.binary())


def records(head: bytes, xyz: np.ndarray) -> pa.Array:
    """A value for each row of (rows, points, d): the head, which is the same for all, and the row's numbers."""
    body = np.ascontiguousarray(xyz, dtype="<f8").reshape(len(xyz), int(np.prod(xyz.shape[1:]))).view(np.uint8)
    out = np.concatenate([np.broadcast_to(np.frombuffer(head, dtype=np.uint8), (len(xyz), len(head))), body], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(out.shape[1]), len(xyz), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def place(parts: list[tuple[np.ndarray, pa.Array]], size: int, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A column of values that are given with their rows; the other rows are null."""
    parts = [(rows, values) for rows, values in parts if len(rows)]
    if not parts:
        return pa.nulls(size, kind)
    at, given, n = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool), 0
    for rows, values in parts:
        at[rows], given[rows] = n + np.arange(len(rows)), True
        n += len(rows)
    return pa.concat_arrays([values for _, values in parts]).take(pa.array(at, mask=~given))


def refill(sample: bytes, g: Geometry, numbers: np.ndarray) -> pa.Array:
    """The sample (g's little-endian ISO form) with each row's numbers in the places of its own."""
    out = np.empty((len(numbers), len(sample)), dtype=np.uint8)
    out[:] = np.frombuffer(sample, dtype=np.uint8)
    out[:, _mask(g, len(sample))] = np.ascontiguousarray(numbers, dtype="<f8").view(np.uint8).reshape(len(numbers), 8 * numbers.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(sample)), len(numbers), [None, pa.py_buffer(out)]).cast(pa.binary())


def fill(g: Group, xyz: np.ndarray) -> Geometry:
    """A row of a group as a geometry, from its coordinates (points, d)."""
    at = iter([(lo, hi) for leaf in g.leaves for lo, hi in leaf.rings])
    take = lambda: xyz[slice(*next(at))]

    def walk(s: Geometry) -> Geometry:
        kind, dims, data = s
        return (kind, dims, take() if kind in (POINT, LINE) else [take() for _ in data] if kind == POLYGON else [walk(p) for p in data])

    return walk(g.sample)


def boxes_to_wkb(column: pa.Array) -> pa.Array:
    """Box structs as polygons."""
    names = ("xmin", "ymin", "xmax", "ymax")
    ok = np.asarray(column.is_valid())
    for n in names:
        ok = ok & np.asarray(column.field(n).is_valid())
    x0, y0, x1, y1 = (column.field(n).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for n in names)
    return place([(np.flatnonzero(ok), records(head(POLYGON, 0, 1, 5), np.stack([x0, y0, x0, y1, x1, y1, x1, y0, x0, y0], axis=1)[ok]))], len(column))
