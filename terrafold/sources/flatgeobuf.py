"""FlatGeobuf: reader and writer as a Python data source named flatgeobuf.

The format is a header, a packed Hilbert R-tree and features, each a FlatBuffers table. The few tables
are read and written here directly. A file is cut into ranges of features by the tree's leaves; the option bbox
("x0,y0,x1,y1") keeps only features whose boxes meet it, found in the tree. It is a prefilter: apply the exact
predicate after it. The option columns names the columns wanted.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from terrafold.functions import wkb

#: Fixed values of the format: magic bytes, node size, column types by number.
MAGIC = b"fgb\x03fgb\x00"
NODE_SIZE, NODE_BYTES = 16, 40
TYPES = ("Byte", "UByte", "Bool", "Short", "UShort", "Int", "UInt", "Long", "ULong", "Float", "Double", "String", "Json", "DateTime", "Binary")
_FIXED = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
_SPARK = {0: ByteType(), 1: ShortType(), 2: BooleanType(), 3: ShortType(), 4: IntegerType(), 5: IntegerType(), 6: LongType(), 7: LongType(), 8: LongType(), 9: FloatType(), 10: DoubleType(), 11: StringType(), 12: StringType(), 13: StringType(), 14: BinaryType()}
_OF_SPARK = {"tinyint": 0, "boolean": 2, "smallint": 3, "int": 5, "bigint": 7, "float": 9, "double": 10, "string": 11, "binary": 14}
#: Features of a task, and features that are looked at for columns where a header has none.
RANGE_FEATURES, SCAN = 50_000, 1000


# FlatBuffers, as far as needed


class _Table:
    """A table in a buffer."""

    def __init__(self, buf: bytes, at: int) -> None:
        self.buf, self.at = buf, at
        self.vtable = at - struct.unpack_from("<i", buf, at)[0]
        self.size = struct.unpack_from("<H", buf, self.vtable)[0]

    def _place(self, i: int) -> int:
        if 4 + 2 * i >= self.size:
            return 0
        off = struct.unpack_from("<H", self.buf, self.vtable + 4 + 2 * i)[0]
        return self.at + off if off else 0

    def scalar(self, i: int, kind: str, default):
        p = self._place(i)
        return struct.unpack_from("<" + kind, self.buf, p)[0] if p else default

    def _target(self, i: int) -> int:
        p = self._place(i)
        return p + struct.unpack_from("<I", self.buf, p)[0] if p else 0

    def table(self, i: int) -> _Table | None:
        p = self._target(i)
        return _Table(self.buf, p) if p else None

    def vector(self, i: int, dtype: str) -> np.ndarray | None:
        p = self._target(i)
        return np.frombuffer(self.buf, dtype=dtype, count=struct.unpack_from("<I", self.buf, p)[0], offset=p + 4) if p else None

    def text(self, i: int) -> str | None:
        v = self.vector(i, "u1")
        return None if v is None else v.tobytes().decode()

    def tables(self, i: int) -> list[_Table]:
        p = self._target(i)
        if not p:
            return []
        n = struct.unpack_from("<I", self.buf, p)[0]
        return [_Table(self.buf, p + 4 + 4 * k + struct.unpack_from("<I", self.buf, p + 4 + 4 * k)[0]) for k in range(n)]


def _root(buf: bytes) -> _Table:
    return _Table(buf, struct.unpack_from("<I", buf, 0)[0])


@dataclass
class _Ref:
    """Something that a table points to: bytes of a vector (count and width), or tables."""

    data: bytes = b""
    count: int = 0
    width: int = 1
    tables: list[dict] | None = None
    one: dict | None = None
    nul: bool = False


class _Writer:
    """Lays tables out front to back; what they point to follows them."""

    def __init__(self) -> None:
        self.out = bytearray(4)

    def _align(self, n: int, ahead: int = 0) -> None:
        while (len(self.out) + 4 + ahead) % n:  # places count from the size prefix
            self.out += b"\0"

    def finish(self, root: dict) -> bytes:
        struct.pack_into("<I", self.out, 0, self._table(root))
        self._align(8)
        return bytes(self.out)

    def _table(self, fields: dict) -> int:
        """fields: slot -> (struct code, value) or _Ref. Returns the table's place."""
        slots = max(fields, default=-1) + 1
        sizes = {i: (4 if isinstance(v, _Ref) else struct.calcsize("<" + v[0])) for i, v in fields.items()}
        order = sorted(fields, key=lambda i: -sizes[i])
        vtable = 4 + 2 * slots
        self._align(8, vtable + vtable % 2)
        self.out += b"\0" * (vtable % 2)
        start = len(self.out)
        at, offsets = start + vtable, {}
        pos = 4
        for i in order:
            pos += -(at + 4 + pos) % sizes[i]
            offsets[i] = pos
            pos += sizes[i]
        self.out += struct.pack("<HH", vtable, pos) + b"".join(struct.pack("<H", offsets.get(i, 0)) for i in range(slots))
        self.out += struct.pack("<i", vtable) + bytes(pos - 4)
        for i, v in fields.items():
            if not isinstance(v, _Ref):
                struct.pack_into("<" + v[0], self.out, at + offsets[i], v[1])
        for i, v in fields.items():
            if isinstance(v, _Ref):
                target = self._ref(v)
                struct.pack_into("<I", self.out, at + offsets[i], target - (at + offsets[i]))
        return at

    def _ref(self, r: _Ref) -> int:
        if r.one is not None:
            return self._table(r.one)
        if r.tables is not None:
            self._align(4)
            at = len(self.out)
            self.out += struct.pack("<I", len(r.tables)) + bytes(4 * len(r.tables))
            for k, t in enumerate(r.tables):
                struct.pack_into("<I", self.out, at + 4 + 4 * k, self._table(t) - (at + 4 + 4 * k))
            return at
        self._align(max(4, r.width), 4)
        at = len(self.out)
        self.out += struct.pack("<I", r.count) + r.data + (b"\0" if r.nul else b"")
        return at


def _string(text: str) -> _Ref:
    b = text.encode()
    return _Ref(b, len(b), 1, nul=True)


def _vector(a: np.ndarray) -> _Ref:
    return _Ref(a.tobytes(), len(a), a.itemsize)


# the format


@dataclass
class Header:
    columns: list[tuple[str, int]] = field(default_factory=list)
    kind: int = 0
    z: bool = False
    m: bool = False
    count: int = 0
    node_size: int = NODE_SIZE
    envelope: tuple = ()
    crs: int = 0
    name: str = ""

    def pack(self) -> bytes:
        fields: dict = {0: _string(self.name), 2: ("B", self.kind), 3: ("?", self.z), 4: ("?", self.m), 8: ("Q", self.count), 9: ("H", self.node_size)}
        fields[7] = _Ref(tables=[{0: _string(n), 1: ("B", t)} for n, t in self.columns])
        if self.envelope:
            fields[1] = _vector(np.array(self.envelope, dtype="<f8"))
        if self.crs:
            fields[10] = _Ref(one={0: _string("EPSG"), 1: ("i", self.crs)})
        body = _Writer().finish(fields)
        return struct.pack("<I", len(body)) + body

    @classmethod
    def unpack(cls, buf: bytes) -> Header:
        t = _root(buf)
        crs = t.table(10)
        env = t.vector(1, "<f8")
        return cls([(c.text(0) or "", c.scalar(1, "B", 0)) for c in t.tables(7)], t.scalar(2, "B", 0), t.scalar(3, "?", False), t.scalar(4, "?", False), t.scalar(8, "Q", 0), t.scalar(9, "H", NODE_SIZE), tuple(env.tolist()) if env is not None else (), crs.scalar(1, "i", 0) if crs else 0, t.text(0) or "")


def tree_levels(n: int, node_size: int = NODE_SIZE) -> list[tuple[int, int]]:
    """First and last node of each level, the leaves first; the root is node 0."""
    sizes = [n]
    while True:
        n = -(-n // node_size)
        sizes.append(n)
        if n == 1:
            break
    out, at = [], sum(sizes)
    for s in sizes:
        out.append((at - s, at))
        at -= s
    return out


def index_bytes(n: int, node_size: int) -> int:
    return tree_levels(n, node_size)[0][1] * NODE_BYTES if n and node_size else 0


_NODE = np.dtype([("box", "<f8", 4), ("at", "<u8")])


def _hilbert(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place on a Hilbert curve of 16-bit coordinates."""
    x, y, d = x.astype(np.int64).copy(), y.astype(np.int64).copy(), np.zeros(len(x), dtype=np.int64)
    s = 1 << 15
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * rx) ^ ry)
        flip = ~ry
        turn = flip & rx
        x[turn], y[turn] = s - 1 - (x[turn] & (s - 1)), s - 1 - (y[turn] & (s - 1))
        x[flip], y[flip] = y[flip].copy(), x[flip].copy()
        s >>= 1
    return d


def build_tree(boxes: np.ndarray, offsets: np.ndarray, node_size: int = NODE_SIZE) -> np.ndarray:
    """The nodes for leaves in file order."""
    levels = tree_levels(len(boxes), node_size)
    nodes = np.zeros(levels[0][1], dtype=_NODE)
    lo, hi = levels[0]
    nodes["box"][lo:hi], nodes["at"][lo:hi] = boxes, offsets
    for (clo, chi), (lo, hi) in zip(levels[:-1], levels[1:], strict=True):
        first = np.arange(clo, chi, node_size)
        own = nodes["box"][clo:chi]
        nodes["box"][lo:hi, :2] = np.minimum.reduceat(own[:, :2], first - clo)
        nodes["box"][lo:hi, 2:] = np.maximum.reduceat(own[:, 2:], first - clo)
        nodes["at"][lo:hi] = first
    return nodes


def search_tree(nodes: np.ndarray, levels: list[tuple[int, int]], node_size: int, box: tuple) -> np.ndarray:
    """Leaves (from 0) whose boxes meet a box."""
    x0, y0, x1, y1 = box
    meets = lambda b: (b[:, 0] <= x1) & (b[:, 2] >= x0) & (b[:, 1] <= y1) & (b[:, 3] >= y0)
    now = np.array([0])
    for (clo, chi), _ in zip(levels[-2::-1], levels[:0:-1], strict=True):
        now = now[meets(nodes["box"][now])]
        first = nodes["at"][now].astype(np.int64)
        now = np.concatenate([np.arange(f, min(f + node_size, chi)) for f in first.tolist()]) if len(first) else np.zeros(0, dtype=np.int64)
    return now[meets(nodes["box"][now])] - levels[0][0] if len(now) else now


def _pack_geometry(g: wkb.Geometry) -> dict:
    kind, dims, data = g
    fields: dict = {6: ("B", kind)}
    if kind in (wkb.MULTIPOLYGON, wkb.COLLECTION):
        fields[7] = _Ref(tables=[_pack_geometry(p) for p in data])
        return fields
    runs = [data] if kind in (wkb.POINT, wkb.LINE) else data if kind == wkb.POLYGON else [p[2] for p in data]
    flat = np.concatenate(runs) if len(runs) else np.zeros((0, wkb.WIDTH[dims]))
    if kind in (wkb.POLYGON, wkb.MULTILINE) and len(runs) > 1:
        fields[0] = _vector(np.cumsum([len(r) for r in runs]).astype("<u4"))
    fields[1] = _vector(np.ascontiguousarray(flat[:, :2], dtype="<f8").reshape(-1))
    if dims in (1, 3):
        fields[2] = _vector(np.ascontiguousarray(flat[:, 2], dtype="<f8"))
    if dims in (2, 3):
        fields[3] = _vector(np.ascontiguousarray(flat[:, -1], dtype="<f8"))
    return fields


def _unpack_geometry(t: _Table, kind: int) -> wkb.Geometry:
    kind = t.scalar(6, "B", 0) or kind
    if kind in (wkb.MULTIPOLYGON, wkb.COLLECTION):
        parts = [_unpack_geometry(p, wkb.POLYGON if kind == wkb.MULTIPOLYGON else 0) for p in t.tables(7)]
        return (kind, parts[0][1] if parts else 0, parts)
    xy, z, m = t.vector(1, "<f8"), t.vector(2, "<f8"), t.vector(3, "<f8")
    xy = (xy if xy is not None else np.zeros(0)).reshape(-1, 2)
    dims = (z is not None and len(z) > 0) + 2 * (m is not None and len(m) > 0)
    c = np.column_stack([xy, *([z] if dims & 1 else []), *([m] if dims & 2 else [])])
    if kind in (wkb.POINT, wkb.LINE):
        return (kind, dims, c)
    if kind == wkb.MULTIPOINT:
        return (kind, dims, [(wkb.POINT, dims, c[i : i + 1]) for i in range(len(c))])
    ends = t.vector(0, "<u4")
    stops = ends.tolist() if ends is not None else [len(c)] if len(c) else []
    runs = [c[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    return (kind, dims, runs if kind == wkb.POLYGON else [(wkb.LINE, dims, r) for r in runs])


def pack_feature(g: wkb.Geometry | None, values: list, columns: list[tuple[str, int]]) -> bytes:
    props = bytearray()
    for i, (v, (_, kind)) in enumerate(zip(values, columns, strict=True)):
        if v is None:
            continue
        props += struct.pack("<H", i)
        if kind in _FIXED:
            props += struct.pack("<" + _FIXED[kind], v)
        else:
            b = bytes(v) if kind == 14 else str(v).encode()
            props += struct.pack("<I", len(b)) + b
    fields: dict = {1: _Ref(bytes(props), len(props), 1)}
    if g is not None:
        fields[0] = _Ref(one=_pack_geometry(g))
    body = _Writer().finish(fields)
    return struct.pack("<I", len(body)) + body


def own_columns(buf: bytes) -> list[tuple[str, int]]:
    """The columns that a feature brings itself, which it may if the header has none."""
    return [(c.text(0) or "", c.scalar(1, "B", 0)) for c in _root(buf).tables(2)]


def unpack_feature(buf: bytes, header: Header) -> tuple[wkb.Geometry | None, list]:
    t = _root(buf)
    g = t.table(0)
    mine = [] if header.columns else own_columns(buf)
    columns = header.columns or mine
    values: list = [None] * len(columns)
    props = t.vector(1, "u1")
    if props is not None:
        raw, at = props.tobytes(), 0
        while at + 2 <= len(raw):
            (i,) = struct.unpack_from("<H", raw, at)
            at += 2
            if i >= len(columns):
                raise ValueError("a feature has a property that neither it nor the header describes")
            kind = columns[i][1]
            if kind in _FIXED:
                (values[i],) = struct.unpack_from("<" + _FIXED[kind], raw, at)
                at += struct.calcsize("<" + _FIXED[kind])
            else:
                (n,) = struct.unpack_from("<I", raw, at)
                body = raw[at + 4 : at + 4 + n]
                values[i] = body if kind == 14 else body.decode()
                at += 4 + n
    return (_unpack_geometry(g, header.kind) if g is not None else None), dict(zip((n for n, _ in mine), values, strict=True)) if mine else values


# files


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs, name


def _head(f) -> tuple[Header, int]:
    """The header, and where the index begins."""
    magic = f.read(8)
    if magic[:4] != MAGIC[:4]:
        raise ValueError("not a FlatGeobuf file")
    (n,) = struct.unpack("<I", f.read(4))
    return Header.unpack(f.read(n)), 12 + n


def list_files(path: str) -> list[str]:
    fs, name = _open(path)
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [scheme + info.path]
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".fgb"))


def write_file(path: str, rows: list[tuple], columns: list[tuple[str, int]], crs: int = 0) -> int:
    """rows: (geometry or None, values). Features lie in Hilbert order, with an index. Returns their number."""
    geoms = [r[0] for r in rows]
    boxes = np.array([(*wkb.coords(g).min(axis=0), *wkb.coords(g).max(axis=0)) if g is not None and not wkb.is_empty(g) else (math.nan,) * 4 for g in geoms], dtype=np.float64).reshape(-1, 4)
    kinds = {g[0] for g in geoms if g is not None}
    dims = {g[1] for g in geoms if g is not None}
    header = Header(columns, kinds.pop() if len(kinds) == 1 else 0, any(d & 1 for d in dims), any(d & 2 for d in dims), len(rows), 0, (), crs)
    order = np.arange(len(rows))
    full = ~np.isnan(boxes[:, 0]) if len(rows) else np.zeros(0, dtype=bool)
    indexed = len(rows) > 0 and full.all()
    if indexed:
        lo, hi = boxes[:, :2].min(axis=0), boxes[:, 2:].max(axis=0)
        header.envelope = (*lo.tolist(), *hi.tolist())
        mid = (boxes[:, :2] + boxes[:, 2:]) / 2
        cell = np.floor((mid - lo) / np.where(hi > lo, hi - lo, 1) * 65535)
        order = np.argsort(-_hilbert(cell[:, 0], cell[:, 1]), kind="stable")
        header.node_size = NODE_SIZE
    features = [pack_feature(geoms[i], list(rows[i][1]), columns) for i in order.tolist()]
    sizes = np.array([len(x) for x in features], dtype=np.int64)
    fs, name = _open(path)
    with fs.open_output_stream(name) as f:
        f.write(MAGIC)
        f.write(header.pack())
        if indexed:
            f.write(build_tree(boxes[order], np.cumsum(sizes) - sizes).tobytes())
        for x in features:
            f.write(x)
    return len(rows)


@dataclass
class _Range(InputPartition):
    """Features of one file: byte spans [start, stop) within the features, or all of it for stop -1."""

    file: str
    base: int
    spans: list[tuple[int, int]]


class FlatGeobufReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[InputPartition]:
        box = tuple(float(v) for v in self.options["bbox"].split(",")) if self.options.get("bbox") else None
        out: list[InputPartition] = []
        for path in list_files(self.options["path"]):
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                header, at = _head(f)
                size = index_bytes(header.count, header.node_size)
                if not size:
                    out.append(_Range(path, at, [(0, -1)]))
                    continue
                f.seek(at)
                nodes = np.frombuffer(f.read(size), dtype=_NODE)
                total = f.size() - at - size
            levels = tree_levels(header.count, header.node_size)
            leaf = nodes["at"][levels[0][0] : levels[0][1]].astype(np.int64)
            stop = np.append(leaf[1:], total)
            keep = np.arange(header.count) if box is None else np.sort(search_tree(nodes, levels, header.node_size, box))
            for k in range(0, len(keep), RANGE_FEATURES):
                own = keep[k : k + RANGE_FEATURES]
                edge = np.flatnonzero(np.diff(own) != 1) + 1
                spans = [(int(leaf[r[0]]), int(stop[r[-1]])) for r in np.split(own, edge)]
                out.append(_Range(path, at + size, spans))
        return out or [_Range("", 0, [])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        box = tuple(float(v) for v in self.options["bbox"].split(",")) if self.options.get("bbox") else None
        want = [f.name for f in self.schema.fields]
        fs, name = _open(partition.file)
        with fs.open_input_file(name) as f:
            header, _ = _head(f)
            names = [n for n, _ in header.columns]
            places = [names.index(n) if n in names else -1 for n in want]
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(self.schema)
            rows: list[list] = []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

            for start, stop in partition.spans:
                f.seek(partition.base + start)
                stop = f.size() - partition.base if stop < 0 else stop
                while start < stop:
                    (n,) = struct.unpack("<I", f.read(4))
                    g, values = unpack_feature(f.read(n), header)
                    start += 4 + n
                    if box is not None and (g is None or wkb.is_empty(g) or not _meets(g, box)):
                        continue
                    if not names:  # a feature's own columns, by name
                        shape = {"geometry": wkb.write(g) if g is not None else None}
                        rows.append([(shape | dict(values)).get(w) for w in want])
                    else:
                        rows.append([(wkb.write(g) if g is not None else None) if w == "geometry" and p < 0 else values[p] if p >= 0 else None for w, p in zip(want, places, strict=True)])
                    if len(rows) >= 4096:
                        yield batch()
                        rows = []
            if rows:
                yield batch()


def _meets(g: wkb.Geometry, box: tuple) -> bool:
    xy = wkb.coords(g)
    (a, b), (c, d) = xy.min(axis=0), xy.max(axis=0)
    return a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class FlatGeobufWriter(DataSourceWriter):
    """A file for each partition; coalesce(1) makes it one."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.schema, self.options, self.overwrite = schema, dict(options), overwrite
        for f in schema.fields:
            if f.name != options.get("geometry", "geometry") and f.dataType.simpleString() not in _OF_SPARK:
                raise ValueError(f"FlatGeobuf has no type for {f.name} {f.dataType.simpleString()}")
        self.old: list[str] = []  # goes when the new files are all there
        if overwrite:
            fs, name = _open(options["path"])
            if fs.get_file_info(name).type == pafs.FileType.Directory:
                self.old = list_files(options["path"])

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        geometry = self.options.get("geometry", "geometry")
        names = [f.name for f in self.schema.fields if f.name != geometry]
        columns = [(f.name, _OF_SPARK[f.dataType.simpleString()]) for f in self.schema.fields if f.name != geometry]
        rows = [(wkb.read(bytes(r[geometry])) if r[geometry] is not None else None, [r[n] for n in names]) for r in iterator]
        if not rows:
            return _Written("", 0)
        ctx = TaskContext.get()
        folder = self.options["path"].rstrip("/")
        fs, name = _open(folder)
        fs.create_dir(name, recursive=True)
        file = f"{folder}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.fgb"
        return _Written(file, write_file(file, rows, columns, int(self.options.get("crs", 0))))

    def commit(self, messages) -> None:
        for path in self.old:
            fs, name = _open(path)
            fs.delete_file(name)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.file:
                fs, name = _open(m.file)
                fs.delete_file(name)


def _first_columns(f, at: int) -> list[tuple[str, int]]:
    """Columns of up to SCAN features, for files whose header has none."""
    found: dict[str, int] = {}
    end = f.size()
    for _ in range(SCAN):
        if at + 4 > end:
            break
        (n,) = struct.unpack("<I", f.read_at(4, at))
        for name, kind in own_columns(f.read_at(n, at + 4)):
            if found.setdefault(name, kind) != kind:
                raise ValueError(f"features disagree on the type of {name}")
        at += 4 + n
    return list(found.items())


class FlatGeobufSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> StructType:
        """Columns of all files' headers (without any, those of a file's first features), then geometry with its type and crs as metadata."""
        found: dict[str, int] = {}
        kinds, codes = set(), set()
        for path in list_files(self.options["path"]):
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                header, at = _head(f)
                kinds.add(header.kind)
                codes.add(header.crs)
                for n, t in header.columns or _first_columns(f, at + index_bytes(header.count, header.node_size)):
                    if found.setdefault(n, t) != t:
                        raise ValueError(f"files disagree on the type of {n}")
        about = {"encoding": "WKB"}
        if len(kinds) == 1 and (kind := kinds.pop()) in wkb.NAMES:
            about["geometry_type"] = wkb.NAMES[kind]
        if len(codes) == 1 and (code := codes.pop()):
            about |= {"crs": f"EPSG:{code}", "crs_type": "authority_code"}
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else [*found, "geometry"]
        shape = lambda n: n == "geometry" and n not in found
        return StructType([StructField(n, BinaryType(), metadata=about) if shape(n) else StructField(n, _SPARK[found[n]]) for n in wanted])

    def reader(self, schema: StructType) -> FlatGeobufReader:
        return FlatGeobufReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FlatGeobufWriter:
        return FlatGeobufWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("flatgeobuf") known to a session."""
    from terrafold.session import ship

    ship(spark)
    spark.dataSource.register(FlatGeobufSource)
