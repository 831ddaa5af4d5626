"""The functions as vectorised Arrow UDFs: one for each SQL name, over WKB, WKT, box structs or point structs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from terrafold.functions import alike, kernels, relate, shapes, wkb, wkt

BOX = StructType([StructField(n, DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
BOX3 = StructType([StructField(n, DoubleType()) for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")])
DUMP = ArrayType(StructType([StructField("path", ArrayType(IntegerType(), False), False), StructField("geom", BinaryType(), False)]), False)
_BOX_NAMES = ("xmin", "ymin", "xmax", "ymax")
RELATIONS = ("intersects", "disjoint", "within", "contains", "equals", "coveredby", "covers", "touches", "crosses", "overlaps")
_ARROW = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _doubles(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are not null, of any numeric column."""
    c = _one(column)
    valid = np.asarray(c.is_valid())
    if pa.types.is_null(c.type):
        return np.zeros(len(c)), valid
    return c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), valid


def _is_box(t: pa.DataType) -> bool:
    return pa.types.is_struct(t) and t.get_field_index("xmin") >= 0


def _grouped(kernel: Callable, kind: str, box: Callable | None = None) -> Callable:
    """A column function from a kernel on groups; box, if given, answers for box structs' six numbers."""

    def run(column: pa.Array) -> pa.Array:
        column = _one(column)
        if box is not None and _is_box(column.type):
            return pa.array(box(*_box_parts(column)), _ARROW[kind], from_pandas=True)
        if kind in ("double", "int"):
            values, valid = np.zeros(len(column), dtype=np.float64 if kind == "double" else np.int32), np.zeros(len(column), dtype=bool)
            for g in wkb.groups(column):
                got = kernel(g)
                if got.dtype == object:
                    ok = np.array([v is not None for v in got])
                    values[g.rows[ok]], valid[g.rows[ok]] = got[ok].astype(values.dtype), True
                else:
                    ok = ~np.isnan(got) if got.dtype.kind == "f" else np.ones(len(got), dtype=bool)
                    values[g.rows[ok]], valid[g.rows[ok]] = got[ok], True
            return pa.array(values, _ARROW[kind], mask=~valid)
        out = np.full(len(column), None, dtype=object)
        for g in wkb.groups(column):
            out[g.rows] = kernel(g)
        return pa.array(out.tolist(), _ARROW[kind])

    return run


def _box_parts(column: pa.Array) -> tuple:
    """xmin, ymin, zmin, xmax, ymax, zmax of a box column as lists with None."""
    get = lambda k: column.field(k).to_pylist() if column.type.get_field_index(k) >= 0 else [None] * len(column)
    live = column.is_valid().to_pylist()
    return tuple([v if ok else None for v, ok in zip(get(k), live, strict=True)] for k in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))


def _each(fn: Callable, kind: str) -> Callable:
    """A column function from a function of one geometry and further numbers; equal arguments are computed once."""

    def run(column: pa.Array, *more) -> pa.Array:
        geoms = wkb.as_geometries(_one(column))
        rest = [_one(c).to_pylist() for c in more]
        seen: dict = {}
        out = []
        for i, g in enumerate(geoms):
            args = tuple(r[i] for r in rest)
            if g is None or any(a is None for a in args):
                out.append(None)
                continue
            key = (id(g), args)
            if key not in seen:
                seen[key] = fn(g, *args)
            v = seen[key]
            out.append(wkb.write(v) if kind == "binary" and v is not None else v)
        return pa.array(out, _ARROW[kind])

    return run


def _as_wkb(column: pa.Array) -> pa.Array:
    """Any accepted form as WKB; WKB as it is."""
    t = column.type
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return column
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return _from_text(column)
    return wkb.boxes_to_wkb(column) if _is_box(t) and len(column) else _binary(column)


def _groups(column: pa.Array) -> list[wkb.Group]:
    """A WKB column's groups; none if a geometry's parts differ in dimensions."""
    try:
        return list(wkb.groups(column))
    except ValueError:
        return []


def _by_class(fn: Callable, kind: str, signs: Callable, spread: Callable | None = None) -> Callable:
    """_each for WKB in few layouts: the function runs once for each class of rows that it treats alike (see alike).

    spread(value, xy, group) gives the values of a class's rows from its first row's, or nothing; without it they are equal.
    """
    slow = _each(fn, kind)

    def run(column: pa.Array, *more) -> pa.Array:
        column, more = _as_wkb(_one(column)), [_one(c) for c in more]
        numbers = [_doubles(c) for c in more]
        live = np.asarray(column.is_valid())
        for _, valid in numbers:
            live = live & valid
        left, parts = live.copy(), []
        for g in _groups(column):
            own = np.flatnonzero(live[g.rows] & np.isfinite(g.xyz).all(axis=(1, 2)))
            if len(own) < alike.FEW or not g.xyz.shape[1]:
                continue
            part = wkb.Group(g.rows[own], g.kind, g.dims, g.leaves, g.top, g.xyz[own], g.sample)
            found = signs(part, *(values[part.rows] for values, _ in numbers))
            if found is None:
                continue
            ok = np.flatnonzero(found[0])
            for at in alike.classes([s[ok] for s in found[1]]) if len(ok) else []:
                if len(at) < 2:
                    continue
                at = ok[at]
                value = fn(wkb.fill(part, part.xyz[at[0]]), *(float(values[part.rows[at[0]]]) for values, _ in numbers))
                xy = part.xyz[at][:, :, :2]
                got = _same_values(value, len(at), kind) if spread is None else spread(value, xy, part)
                if got is not None:
                    parts.append((part.rows[at], got))
                    left[part.rows[at]] = False
        rest = np.flatnonzero(left)
        if len(rest):
            parts.append((rest, slow(column.take(pa.array(rest)), *(c.take(pa.array(rest)) for c in more))))
        return wkb.place(parts, len(column), _ARROW[kind])

    return run


def _same_values(value, n: int, kind: str) -> pa.Array:
    return pa.array([value] * n, _ARROW[kind])


def _vertices_of(value: wkb.Geometry, xy: np.ndarray, g: wkb.Group) -> pa.Array | None:
    """A geometry whose vertices are those of its argument."""
    places = alike.Places(xy, value)
    return places.values if places.known else None


def _reasons(value: str, xy: np.ndarray, g: wkb.Group) -> pa.Array | None:
    """Reasons with a class's words and each row's point."""
    if "[" not in value:
        return _same_values(value, len(xy), "string")
    why = relate.invalid_point(wkb.fill(g, np.concatenate([xy[0], np.zeros((xy.shape[1], wkb.WIDTH[g.dims] - 2))], axis=1)))
    at = alike.meeting(xy, g, why[1]) if why[1] is not None else None
    if at is None or np.isnan(at).any():
        return None
    text = wkt.numbers(at)
    return pa.array([f"{why[0]}[{x} {y}]" for x, y in text.tolist()], pa.string())


def _bounds(names: tuple[str, ...], picks: tuple[int, ...]) -> Callable:
    def run(column: pa.Array) -> pa.Array:
        column = _one(column)
        out = np.full((len(column), 6), np.nan)
        if _is_box(column.type):
            out = np.array(_box_parts(column), dtype=np.float64).T.reshape(-1, 6)
        else:
            for g in wkb.groups(column):
                out[g.rows] = kernels.bounds(g)
        none = np.isnan(out[:, 0])
        cols = [pa.array(out[:, p], from_pandas=True) for p in picks]
        return pa.StructArray.from_arrays(cols, names=list(names), mask=pa.array(none))

    return run


def _extreme(pick: int) -> Callable:
    def run(column: pa.Array) -> pa.Array:
        box = _bounds(("v",), (pick,))(column)
        return pa.array(box.field(0).to_numpy(zero_copy_only=False), pa.float64(), from_pandas=True)

    return run


def _points(dims: int) -> Callable:
    def run(*columns) -> pa.Array:
        got = [_doubles(c) for c in columns[: wkb.WIDTH[dims]]]
        valid = np.logical_and.reduce([v for _, v in got])
        return wkb.points_to_wkb([x for x, _ in got], dims, valid)

    return run


def _corners(dims: int) -> Callable:
    names = _BOX_NAMES if dims == 2 else ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")

    def run(low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(wkb.as_geometries(_one(low)), wkb.as_geometries(_one(high)), strict=True):
            if a is None or b is None or not len(a[2]) or not len(b[2]):
                out.append(None)
                continue
            if a[0] != wkb.POINT or b[0] != wkb.POINT or (dims == 3 and not (a[1] & 1 and b[1] & 1)):
                raise ValueError(f"box corners must be {dims}-D points")
            out.append(dict(zip(names, [*a[2][0, :dims].tolist(), *b[2][0, :dims].tolist()], strict=True)))
        return pa.array(out, pa.struct([(n, pa.float64()) for n in names]))

    return run


def _expand(column: pa.Array, dx: pa.Array, dy: pa.Array | None = None) -> pa.Array:
    x, xv = _doubles(dx)
    y, yv = _doubles(dy if dy is not None else dx)
    s = _bounds(_BOX_NAMES, (0, 1, 3, 4))(column)
    x0, y0, x1, y1 = (s.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    bad = ~np.asarray(s.is_valid()) | ~xv | ~yv
    return pa.StructArray.from_arrays([pa.array(v) for v in (x0 - x, y0 - y, x1 + x, y1 + y)], names=list(_BOX_NAMES), mask=pa.array(bad))


def _centroid(column: pa.Array) -> pa.Array:
    out = np.full((len(column), 2), np.nan)
    valid = np.zeros(len(column), dtype=bool)
    for g in wkb.groups(_one(column)):
        out[g.rows], valid[g.rows] = kernels.centroid(g), True
    return wkb.points_to_wkb([out[:, 0], out[:, 1]], 0, valid)


def _by_arrays(kernel: Callable, slow: Callable) -> Callable:
    """WKB columns by a kernel that gives values for a group's rows, other columns by a function for each geometry."""

    def run(column: pa.Array, *more) -> pa.Array:
        column = _one(column)
        if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
            return slow(column, *more)
        return wkb.place([part for g in wkb.groups(column) for part in kernel(g, *map(_one, more))], len(column))

    return run


def _vertices(g: wkb.Group, rows: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    return rows, wkb.records(wkb.head(wkb.POINT, g.dims), xyz)


def _end_arrays(last: bool) -> Callable:
    def run(g: wkb.Group) -> list:
        return [_vertices(g, g.rows, g.xyz[:, -1 if last else 0])] if g.kind == wkb.LINE and g.xyz.shape[1] else []

    return run


def _point_n_arrays(g: wkb.Group, numbers: pa.Array) -> list:
    size = g.xyz.shape[1]
    if g.kind != wkb.LINE or not size:
        return []
    n = numbers.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)[g.rows]
    ok = np.flatnonzero((n != 0) & (np.abs(n) <= size))
    n = n[ok]
    return [_vertices(g, g.rows[ok], g.xyz[ok, np.where(n > 0, n - 1, size + n)])]


def _envelope_arrays(g: wkb.Group) -> list:
    if not g.xyz.shape[1]:
        return [(g.rows, pa.array([wkb.write(g.sample)] * len(g.rows), pa.binary()))]
    x0, y0, x1, y1 = kernels.bounds(g)[:, [0, 1, 3, 4]].T
    point, flat = (x0 == x1) & (y0 == y1), (x0 == x1) ^ (y0 == y1)
    out = []
    for own, head, corners in (
        (point, wkb.head(wkb.POINT, 0), (x0, y0)),
        (flat, wkb.head(wkb.LINE, 0, 2), (x0, y0, x1, y1)),
        (~point & ~flat, wkb.head(wkb.POLYGON, 0, 1, 5), (x0, y0, x0, y1, x1, y1, x1, y0, x0, y0)),
    ):
        out.append((g.rows[own], wkb.records(head, np.stack(corners, axis=1)[own])))
    return out


def _end(last: bool) -> Callable:
    def run(g: wkb.Geometry) -> wkb.Geometry | None:
        if g[0] != wkb.LINE or not len(g[2]):
            return None
        return (wkb.POINT, g[1], g[2][-1:] if last else g[2][:1])

    return run


def _point_n(g: wkb.Geometry, n: int) -> wkb.Geometry | None:
    if g[0] != wkb.LINE or not n or abs(n) > len(g[2]):
        return None
    k = n - 1 if n > 0 else len(g[2]) + n
    return (wkb.POINT, g[1], g[2][k : k + 1])


def _dump(column: pa.Array) -> pa.Array:
    def walk(g: wkb.Geometry, path: list[int]) -> list[dict]:
        if g[0] <= wkb.POLYGON:
            return [{"path": path, "geom": wkb.write(g)}]
        return [x for k, p in enumerate(g[2], 1) for x in walk(p, [*path, k])]

    out = [None if g is None else [] if wkb.is_empty(g) else walk(g, []) for g in wkb.as_geometries(_one(column))]
    return pa.array(out, pa.list_(pa.struct([pa.field("path", pa.list_(pa.field("element", pa.int32(), False)), False), pa.field("geom", pa.binary(), False)])))


def _distance(left: pa.Array, right: pa.Array) -> pa.Array:
    left, right = _one(left), _one(right)
    out, valid = np.zeros(len(left)), np.zeros(len(left), dtype=bool)
    slow = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
    a, b = _plain_points(left), _plain_points(right)
    if a is not None and b is not None:
        ok = slow & ~np.isnan(a[:, 0]) & ~np.isnan(b[:, 0])
        gap = a[ok] - b[ok]
        out[ok], valid[ok] = np.hypot(gap[:, 0], gap[:, 1]), True
        return pa.array(out, mask=~valid)
    ga, gb = wkb.as_geometries(left), wkb.as_geometries(right)
    return pa.array([None if x is None or y is None else shapes.distance(x, y) for x, y in zip(ga, gb, strict=True)], pa.float64())


def _plain_points(column: pa.Array) -> np.ndarray | None:
    """XY of a column of points only; NaN for null and empty; None for other columns."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        return None
    out = np.full((len(column), 2), np.nan)
    for g in wkb.groups(column):
        if g.kind != wkb.POINT:
            return None
        if g.xyz.shape[1]:
            out[g.rows] = g.xyz[:, 0, :2]
    return out


def _relation(name: str) -> Callable:
    """A predicate on two columns. A constant side is taken apart once, point columns skip those outside its box, and rows of equal layouts go by classes."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        left, right = _one(left), _one(right)
        parts: dict[int, relate.Parts] = {}

        def of(g: wkb.Geometry) -> relate.Parts:
            if id(g) not in parts:
                parts[id(g)] = relate.Parts(g)
            return parts[id(g)]

        ga, gb = wkb.as_geometries(left), wkb.as_geometries(right)
        out: list[bool | None] = [None] * len(ga)
        seen: dict[tuple[int, int], bool] = {}
        for i, (x, y) in enumerate(zip(ga, gb, strict=True)):
            if x is None or y is None:
                continue
            key = (id(x), id(y))
            if key not in seen:
                seen[key] = relate.predicate(name, of(x), of(y))
            out[i] = seen[key]
        return pa.array(out, pa.bool_())

    def by_class(left: pa.Array, right: pa.Array) -> pa.Array:
        """Rows of equal layouts by classes (see alike), the others one by one."""
        left, right = _as_wkb(left), _as_wkb(right)
        live = np.asarray(left.is_valid()) & np.asarray(right.is_valid())
        one = lambda i: run(left.slice(i, 1), right.slice(i, 1))[0].as_py()
        ga, gb = _groups(left), _groups(right)
        at = np.zeros((4, len(left)), dtype=np.int64)
        for k, groups in ((0, ga), (2, gb)):
            at[k] = -1
            for n, g in enumerate(groups):
                at[k, g.rows], at[k + 1, g.rows] = n, np.arange(len(g.rows))
        left_over, parts = live.copy(), []
        both = np.flatnonzero(live & (at[0] >= 0) & (at[2] >= 0))
        code = at[0, both] * (len(gb) + 1) + at[2, both]
        by = np.argsort(code, kind="stable")
        for own in np.split(both[by], np.flatnonzero(np.diff(code[by])) + 1):
            if len(own) < alike.FEW:
                continue
            values, known = alike.relation(name, ga[at[0, own[0]]], gb[at[2, own[0]]], own, at[1, own], at[3, own], one)
            parts.append((own[known], pa.array(values[known])))
            left_over[own[known]] = False
        rest = np.flatnonzero(left_over)
        if len(rest):
            parts.append((rest, run(left.take(pa.array(rest)), right.take(pa.array(rest)))))
        return wkb.place(parts, len(left), pa.bool_())

    def fast(left: pa.Array, right: pa.Array) -> pa.Array:
        """Point columns against one polygon: even-odd counting on arrays, boundary cases one by one."""
        left, right = _one(left), _one(right)
        flip = {"intersects": "intersects", "within": "contains", "coveredby": "covers", "contains": "within", "covers": "coveredby"}
        if name in flip and len(left) > 64:
            for pts, area, rel in ((left, right, name), (right, left, flip[name])):
                if rel not in ("intersects", "within", "coveredby"):
                    continue
                got = _points_in_one(pts, area, rel)
                if got is not None:
                    return got
        return by_class(left, right)

    return fast


def _points_in_one(pts: pa.Array, area: pa.Array, rel: str) -> pa.Array | None:
    if pa.types.is_nested(area.type) or area.null_count or len(area.unique()) != 1:
        return None
    g = wkb.as_geometries(area.slice(0, 1))[0]
    if g is None or g[0] not in (wkb.POLYGON, wkb.MULTIPOLYGON):
        return None
    xy = _plain_points(pts)
    if xy is None:
        return None
    p = relate.Parts(g)
    hit = np.zeros(len(xy), dtype=bool)
    for a in p.areas:
        near = np.flatnonzero(((xy >= a.lo) & (xy <= a.hi)).all(axis=1))
        if not len(near):
            continue
        q = xy[near]
        inside, doubt = np.zeros(len(q), dtype=bool), np.zeros(len(q), dtype=bool)
        for (x0, y0), (x1, y1) in a.edges.tolist():
            l, r = (x0 - q[:, 0]) * (y1 - q[:, 1]), (y0 - q[:, 1]) * (x1 - q[:, 0])
            det = l - r
            doubt |= (np.abs(det) <= 1e-14 * (np.abs(l) + np.abs(r))) & (q[:, 1] >= min(y0, y1)) & (q[:, 1] <= max(y0, y1)) & (q[:, 0] >= min(x0, x1)) & (q[:, 0] <= max(x0, x1))
            up = (y0 <= q[:, 1]) != (y1 <= q[:, 1])
            inside ^= up & ((det > 0) == (y1 > y0))
        for k in np.flatnonzero(doubt).tolist():
            place = a.locate(tuple(q[k].tolist()))
            inside[k] = place == relate.I or (place == relate.B and rel != "within")
        hit[near[inside]] = True
    return pa.array(hit, mask=~np.asarray(pts.is_valid()))


def _geohash(column: pa.Array) -> pa.Array:
    from terrafold.functions.geohash import ALPHABET, LENGTH

    def one(g: wkb.Geometry) -> str | None:
        if g[0] != wkb.POINT:
            raise ValueError("ST_GeoHash takes points")
        if not len(g[2]):
            return None
        x, y = g[2][0, :2].tolist()
        if not (-180 <= x <= 180 and -90 <= y <= 90):
            raise ValueError("coordinates are outside the GeoHash range")
        cx, cy = (min(int((v / span + 0.5) * (1 << 30)), (1 << 30) - 1) for v, span in ((x, 360.0), (y, 180.0)))
        bits = "".join(a + b for a, b in zip(f"{cx:030b}", f"{cy:030b}", strict=True))
        return "".join(ALPHABET[int(bits[5 * k : 5 * k + 5], 2)] for k in range(LENGTH))

    return _each(one, "string")(column)


def _hash_box(h: str) -> tuple[float, float, float, float]:
    from terrafold.functions.geohash import ALPHABET

    if any(c not in ALPHABET for c in h):
        raise ValueError(f"not a GeoHash: {h!r}")
    bits = "".join(f"{ALPHABET.index(c):05b}" for c in h)
    bx, by = bits[::2], bits[1::2]
    wx, wy = 360.0 / 2 ** len(bx), 180.0 / 2 ** len(by)
    x, y = (int(bx, 2) if bx else 0) * wx - 180, (int(by, 2) if by else 0) * wy - 90
    return x, y, x + wx, y + wy


def _box_from_hash(column: pa.Array) -> pa.Array:
    out = [None if h is None else dict(zip(_BOX_NAMES, _hash_box(h), strict=True)) for h in _one(column).to_pylist()]
    return pa.array(out, pa.struct([(n, pa.float64()) for n in _BOX_NAMES]))


def _point_from_hash(column: pa.Array) -> pa.Array:
    out = []
    for h in _one(column).to_pylist():
        b = None if h is None else _hash_box(h)
        out.append(None if b is None else wkb.write((wkb.POINT, 0, np.array([[(b[0] + b[2]) / 2, (b[1] + b[3]) / 2]]))))
    return pa.array(out, pa.binary())


def _from_text(column: pa.Array) -> pa.Array:
    """Texts that differ in their numbers only are parsed once; numbers go to their places in the WKB."""
    texts = _one(column)
    if pa.types.is_null(texts.type):
        return pa.nulls(len(texts), pa.binary())
    texts = texts.dictionary_encode()
    given, distinct = texts.indices, texts.dictionary
    forms = pc.replace_substring_regex(distinct, pattern=wkt.NUMBER, replacement="#").dictionary_encode()
    marked = np.asarray(pc.match_substring(distinct, "#"))
    form = forms.indices.to_numpy(zero_copy_only=False)
    by = np.argsort(form, kind="stable")
    parts = []
    for own in np.split(by, np.flatnonzero(np.diff(form[by])) + 1):
        if not len(own):
            continue
        words = distinct.take(pa.array(own)).to_pylist()
        g = wkt.parse(words[0])
        sample = wkb.write(g)
        numbers = wkt.floats(words)
        size = int(wkb._mask(g, len(sample)).sum()) // 8
        if not marked[own].any() and size and len(numbers) == size * len(own):
            values = wkb.refill(sample, g, numbers.reshape(len(own), size))
            if values[0].as_py() == sample:
                parts.append((own, values))
                continue
        parts.append((own, pa.array([wkb.write(wkt.parse(t)) for t in words], pa.binary())))
    return wkb.place(parts, len(distinct)).take(given)


def _as_text(column: pa.Array) -> pa.Array:
    column = _as_wkb(_one(column))
    out = np.full(len(column), None, dtype=object)
    groups = _groups(column)
    if not groups:
        return _each(wkt.format, "string")(column)
    for g in groups:
        form = wkt.format(g.sample, lambda _: "%s")
        size = g.xyz.shape[1] * g.xyz.shape[2]
        out[g.rows] = [form % tuple(r) for r in wkt.numbers(g.xyz.reshape(len(g.rows), size)).tolist()] if size else form
    return pa.array(out.tolist(), pa.string())


def _binary(column: pa.Array) -> pa.Array:
    """Little-endian ISO WKB of any accepted form."""
    return pa.array([None if g is None else wkb.write(g) for g in wkb.as_geometries(_one(column))], pa.binary())


def _area_of_box(x0, y0, z0, x1, y1, z1):
    return [None if a is None or c is None else (c - a) * (d - b) for a, b, c, d in zip(x0, y0, x1, y1, strict=True)]


def _line_merge(column: pa.Array, directed: pa.Array | None = None) -> pa.Array:
    flags = [False] * len(column) if directed is None else [bool(v) for v in _one(directed).to_pylist()]
    out = [None if g is None else wkb.write(shapes.line_merge(g, f)) for g, f in zip(wkb.as_geometries(_one(column)), flags, strict=True)]
    return pa.array(out, pa.binary())


#: SQL name: (column function, result type, least and most arguments).
TABLE: dict[str, tuple[Callable, object, int, int]] = {
    "st_point": (_points(0), BinaryType(), 2, 3),
    "st_pointz": (_points(1), BinaryType(), 3, 4),
    "st_pointm": (_points(2), BinaryType(), 3, 4),
    "st_pointzm": (_points(3), BinaryType(), 4, 5),
    "st_makepoint": (lambda *c: _points({2: 0, 3: 1, 4: 3}[len(c)])(*c), BinaryType(), 2, 4),
    "st_makepointm": (_points(2), BinaryType(), 3, 3),
    "st_coorddim": (_grouped(kernels.n_dims, "int"), IntegerType(), 1, 1),
    "st_ndims": (_grouped(kernels.n_dims, "int"), IntegerType(), 1, 1),
    "geometrytype": (_grouped(kernels.type_upper, "string"), StringType(), 1, 1),
    "st_geometrytype": (_grouped(kernels.type_st, "string"), StringType(), 1, 1),
    "st_isclosed": (_grouped(kernels.is_closed, "boolean", lambda *b: [None if v is None else False for v in b[0]]), BooleanType(), 1, 1),
    "st_isempty": (_grouped(kernels.is_empty, "boolean"), BooleanType(), 1, 1),
    "st_dump": (_dump, DUMP, 1, 1),
    "st_startpoint": (_by_arrays(_end_arrays(False), _each(_end(False), "binary")), BinaryType(), 1, 1),
    "st_endpoint": (_by_arrays(_end_arrays(True), _each(_end(True), "binary")), BinaryType(), 1, 1),
    "st_pointn": (_by_arrays(_point_n_arrays, _each(_point_n, "binary")), BinaryType(), 2, 2),
    "st_npoints": (_grouped(kernels.n_points, "int", lambda *b: [None if v is None else 4 for v in b[0]]), IntegerType(), 1, 1),
    "st_numinteriorrings": (_grouped(kernels.n_interior_rings, "int"), IntegerType(), 1, 1),
    "st_x": (_grouped(kernels.ordinate("x"), "double"), DoubleType(), 1, 1),
    "st_y": (_grouped(kernels.ordinate("y"), "double"), DoubleType(), 1, 1),
    "st_z": (_grouped(kernels.ordinate("z"), "double"), DoubleType(), 1, 1),
    "st_m": (_grouped(kernels.ordinate("m"), "double"), DoubleType(), 1, 1),
    "box2d": (_bounds(_BOX_NAMES, (0, 1, 3, 4)), BOX, 1, 1),
    "box3d": (_bounds(tuple(BOX3.names), (0, 1, 2, 3, 4, 5)), BOX3, 1, 1),
    "st_xmin": (_extreme(0), DoubleType(), 1, 1),
    "st_ymin": (_extreme(1), DoubleType(), 1, 1),
    "st_zmin": (_extreme(2), DoubleType(), 1, 1),
    "st_xmax": (_extreme(3), DoubleType(), 1, 1),
    "st_ymax": (_extreme(4), DoubleType(), 1, 1),
    "st_zmax": (_extreme(5), DoubleType(), 1, 1),
    "st_makebox2d": (_corners(2), BOX, 2, 2),
    "st_3dmakebox": (_corners(3), BOX3, 2, 2),
    "st_expand": (_expand, BOX, 2, 3),
    "st_envelope": (_by_arrays(_envelope_arrays, _each(shapes.envelope, "binary")), BinaryType(), 1, 1),
    "st_geomfromtext": (_from_text, BinaryType(), 1, 1),
    "st_astext": (_as_text, StringType(), 1, 1),
    "st_geomfromwkb": (_binary, BinaryType(), 1, 1),
    "st_asbinary": (_binary, BinaryType(), 1, 1),
    "st_area": (_grouped(kernels.area, "double", _area_of_box), DoubleType(), 1, 1),
    "st_distance": (_distance, DoubleType(), 2, 2),
    "st_length": (_grouped(kernels.length, "double"), DoubleType(), 1, 1),
    "st_centroid": (_centroid, BinaryType(), 1, 1),
    "st_convexhull": (_by_class(shapes.convex_hull, "binary", alike.all_turns, _vertices_of), BinaryType(), 1, 1),
    "st_concavehull": (_by_class(lambda g, r: shapes.concave_hull(g, float(r)), "binary", alike.concave_signs, _vertices_of), BinaryType(), 2, 2),
    "st_orientedenvelope": (_each(shapes.oriented_envelope, "binary"), BinaryType(), 1, 1),
    "st_pointonsurface": (_each(shapes.point_on_surface, "binary"), BinaryType(), 1, 1),
    "st_simplify": (_by_class(lambda g, t: shapes.simplify(g, float(t)), "binary", alike.simplify_signs, _vertices_of), BinaryType(), 2, 2),
    "st_simplifyvw": (_each(lambda g, t: shapes.simplify_vw(g, float(t)), "binary"), BinaryType(), 2, 2),
    "st_simplifypreservetopology": (_by_class(lambda g, t: shapes.simplify_preserve(g, float(t)), "binary", alike.preserve_signs, _vertices_of), BinaryType(), 2, 2),
    "st_linemerge": (_line_merge, BinaryType(), 1, 2),
    "st_isvalid": (_by_class(lambda g: relate.invalid_reason(g) is None, "boolean", alike.own_turns), BooleanType(), 1, 1),
    "st_isvalidreason": (_by_class(lambda g: relate.invalid_reason(g) or "Valid Geometry", "string", alike.own_turns, _reasons), StringType(), 1, 1),
    "st_geohash": (_geohash, StringType(), 1, 1),
    "st_box2dfromgeohash": (_box_from_hash, BOX, 1, 1),
    "st_pointfromgeohash": (_point_from_hash, BinaryType(), 1, 1),
} | {f"st_{name}": (_relation(name), BooleanType(), 2, 2) for name in RELATIONS}

#: Fixed names: further SQL names of functions.
ALIASES = {
    "st_numpoints": "st_npoints",
    "st_numinteriorring": "st_numinteriorrings",
    "st_geometryfromtext": "st_geomfromtext",
    "st_wkttosql": "st_geomfromtext",
    "st_wkbtosql": "st_geomfromwkb",
    "st_length2d": "st_length",
}


def make_udf(name: str):
    """The Arrow UDF for a SQL name; it refuses a wrong number of arguments when it runs."""
    fn, kind, least, most = TABLE[ALIASES.get(name, name)]

    def run(*columns: pa.Array) -> pa.Array:
        if not least <= len(columns) <= most:
            raise ValueError(f"{name} takes {least} to {most} arguments, not {len(columns)}")
        return fn(*columns)

    run.__name__ = name
    return arrow_udf(run, kind)


@arrow_udf(BOX)
def extent_udf(column: pa.Array) -> pa.Scalar:
    """ST_Extent as a grouped aggregate, for SQL."""
    s = _bounds(_BOX_NAMES, (0, 1, 3, 4))(column)
    ok = s.filter(s.is_valid())
    if not len(ok):
        return pa.scalar(None, pa.struct([(n, pa.float64()) for n in _BOX_NAMES]))
    x0, y0, x1, y1 = (ok.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    return pa.scalar({"xmin": x0.min(), "ymin": y0.min(), "xmax": x1.max(), "ymax": y1.max()}, pa.struct([(n, pa.float64()) for n in _BOX_NAMES]))
