"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance <= 2 - 2c. A fixed rotation spreads the distance over all
coordinates; these are split into blocks, and each block gets a part of the squared distance in proportion to
its dimensions. A pair within the whole budget is within the part of one block at least, so the union of the
blocks' range joins has every link. A block's range join finds, for each vector, those in the box of its radius
around it: every coordinate is cut into bins of equal numbers, a bitmap for each cut says which vectors lie below
it, and a box is the intersection of one bitmap difference for each coordinate. Only what lies in the box gets its
distance over the block computed (0.8 % of the pairs of unrelated vectors for blocks of 8 of 64 dimensions), and only
what is within the block's budget (0.02 %) gets its full vectors verified in double precision. A link is counted in the
first block that finds it.

A label of up to TILE different vectors is one task, which does all blocks: its vectors are shuffled once. Larger
labels are written to the shared folder in tiles of about TILE vectors, once, and each pair of tiles is a task that
reads two of them: a hot label costs no more disk than its own vectors, and as many tasks as it has tile pairs.
Tasks return link counts and a spanning forest of their links, so rows stay linear in the vectors however dense a
cluster is. Equal vectors of a label are one class, compared once and counted by their number.

Cases: a vector that is null, empty, zero or holds a null or non-finite component, and one whose label is
null, links with nothing; vectors of different dimensions don't link. Every row is a vector of its own, whatever
its id: repeated rows are copies that link with each other, and rows of one id with different vectors link only if
they are near; component_id is the least id of the rows that are reachable. A null id is larger than all others
and stays null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.batches import NO_ID, trim
from terrafold.llm.links import components
from terrafold.llm.words import combine, mix
from terrafold.session import fresh_path, materialize, ship

COSINE, BLOCK_DIMS, SLACK = 0.93, 8, 1e-9
#: Vectors of a task, bins of a coordinate, vectors whose boxes are looked up at once, and pairs measured at once.
TILE, BINS, CHUNK, PAIRS = 32_768, 256, 128, 1 << 18
_U = np.uint64


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_501 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of(dim: int) -> np.ndarray:
    """Where the blocks begin and end."""
    blocks = max(1, dim // BLOCK_DIMS)
    return np.linspace(0, dim, blocks + 1).round().astype(int)


def _decode(blobs: list[bytes], dim: int) -> np.ndarray:
    kind = "<f4" if len(blobs[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(blobs: list[bytes], dims: list[int]) -> np.ndarray:
    """Unit vectors of one dimension, each stored as floats or doubles."""
    out = np.empty((len(blobs), dims[0]))
    wide = np.array([len(b) for b in blobs]) == 8 * dims[0]
    for flag in (False, True):
        at = np.flatnonzero(wide == flag)
        if len(at):
            out[at] = _decode([blobs[i] for i in at.tolist()], dims[0])
    return out


def _prepare(rows: DataFrame) -> DataFrame:
    """All rows; usable vectors as bytes, with a 128-bit fingerprint of their values, of the others the id alone."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            size = pc.list_value_length(rb.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            flat = rb.column(2).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype("<f8")
            f1, f2, blob = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [None] * len(size)
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)] + 0.0  # -0.0 equals 0.0
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[good], x[good]
                with np.errstate(over="ignore", under="ignore"):
                    norm = (x * x).sum(axis=1)
                far = np.flatnonzero(~np.isfinite(norm) | (norm <= 0))  # squares out of range
                x[far] /= np.abs(x[far]).max(axis=1, keepdims=True)
                h = mix(x.view(_U) + np.arange(dim, dtype=_U) * _U(0x9E3779B97F4A7C15))
                f1[at] = h.sum(axis=1, dtype=_U).view(np.int64)
                f2[at] = combine(h, h ^ _U(0x5DEECE66D)).sum(axis=1, dtype=_U).view(np.int64)
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype("<f4")
                exact = (short == x).all(axis=1)
                for k, i in enumerate(at.tolist()):
                    blob[i] = short[k].tobytes() if exact[k] else x[k].tobytes()
            usable = np.array([b is not None for b in blob], dtype=bool) & rb.column(1).is_valid().to_numpy(zero_copy_only=False)
            vec = pa.array([b if u else None for b, u in zip(blob, usable.tolist(), strict=True)], pa.binary())
            cols = [pa.array(c, t, mask=~usable) for c, t in ((size, pa.int32()), (f1, pa.int64()), (f2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *cols, vec], names=["id", "label", "dim", "f1", "f2", "vec"])

    return rows.mapInArrow(run, "id long, label string, dim int, f1 long, f2 long, vec binary")


class BoxIndex:
    """Vectors by coordinate: which of them lie in a box, as bitmaps."""

    def __init__(self, x: np.ndarray) -> None:
        n, dims = x.shape
        self.words = -(-n // 64)
        bins = min(BINS, n)
        cut = np.arange(bins + 1) * n // bins
        self.maps, self.first, self.last = [], [], []
        for d in range(dims):
            order = np.argsort(x[:, d], kind="stable")
            below = np.zeros((bins + 1, 64 * self.words), dtype=bool)
            below[np.searchsorted(cut, np.arange(n), side="right"), order] = True
            self.maps.append(np.bitwise_or.accumulate(np.packbits(below, axis=1, bitorder="little").view(_U), axis=0))
            value = x[order, d]
            self.first.append(value[cut[:-1]])  # the least of each bin
            self.last.append(value[cut[1:] - 1])  # and the largest

    def boxes(self, x: np.ndarray, radius: float, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of x, vector) of all vectors from number begin on that share a bin with the row's box in every coordinate."""
        skip = begin // 64
        inside = None
        for d, maps in enumerate(self.maps):
            lo = np.searchsorted(self.last[d], x[:, d] - radius, side="left")
            hi = np.searchsorted(self.first[d], x[:, d] + radius, side="right")
            own = maps[:, skip:][hi] ^ maps[:, skip:][np.minimum(lo, hi)]
            inside = own if inside is None else np.bitwise_and(inside, own, out=inside)
        octets = inside.view(np.uint8).reshape(-1)
        some = np.flatnonzero(octets)
        row, bit = np.nonzero(np.unpackbits(octets[some][:, None], axis=1, bitorder="little"))
        at = some[row] * 8 + bit
        width = 64 * (self.words - skip)
        return at // width, at % width + 64 * skip


def near_pairs(x: np.ndarray, n: int, cosine: float, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (p, q) among unit vectors, each once: p of the first n and q of the rest, or p < q of all if n is their number.

    seen, if given, gets how many pairs each block's boxes left to be measured.
    """
    dim = x.shape[1]
    edge = edges_of(dim)
    y = x @ rotation(dim)
    budget = (2 - 2 * cosine) * np.diff(edge) / dim + SLACK
    parts = [np.ascontiguousarray(y[:, a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    base = 0 if n == len(x) else n
    for block, part in enumerate(parts):
        index = BoxIndex(part[base:])
        radius = np.sqrt(budget[block]) * (1 + 1e-9)
        measured = 0
        for k in range(0, n, CHUNK):
            p, q = index.boxes(part[k : min(n, k + CHUNK)], radius, 0 if base else k)
            p, q = p + k, q + base
            if not base:
                p, q = p[p < q], q[p < q]
            measured += len(p)
            for s in range(0, len(p), PAIRS):
                i, j = p[s : s + PAIRS], q[s : s + PAIRS]
                ok = _gap(part, i, j) <= budget[block]
                i, j = i[ok], j[ok]
                ok = (x[i] * x[j]).sum(axis=1) >= cosine
                for other in range(block):  # found before
                    ok[ok] = _gap(parts[other], i[ok], j[ok]) > budget[other]
                if ok.any():
                    yield i[ok], j[ok]
        if seen is not None:
            seen.append(measured)


def _gap(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances; coordinate by coordinate, so that a pair's is the same whatever it is computed with."""
    out = np.zeros(len(i))
    for d in range(part.shape[1]):
        step = part[i, d] - part[j, d]
        out += step * step
    return out


_FOUND = "node long, links long, root long"


def _forest(node: np.ndarray, cnt: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Link counts and a spanning forest of the links."""
    degree, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    for p, q in pairs:
        np.add.at(degree, p, cnt[q])
        np.add.at(degree, q, cnt[p])
        while len(p):
            a, b = root[p], root[q]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            root = root[root]
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
    while not np.array_equal(root, root[root]):
        root = root[root]
    keep = np.flatnonzero(degree > 0)
    return pa.table({"node": pa.array(node[keep], pa.int64()), "links": pa.array(degree[keep], pa.int64()), "root": pa.array(node[root[keep]], pa.int64())})


def _whole(cosine: float):
    """All links of a label."""

    def run(table: pa.Table) -> pa.Table:
        x = _units(table["vec"].to_pylist(), [table["dim"][0].as_py()])
        out = _forest(table["node"].to_numpy(), table["cnt"].to_numpy(), near_pairs(x, len(x), cosine))
        trim()
        return out

    return run


def _by_tiles(big: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """Links of large labels, tile by tile."""
    path = fresh_path(big.sparkSession, "tiles")
    # a label's number stands for it in paths
    slots = materialize(sizes.select("label", "dim", F.ceil(F.col("n") / TILE).alias("tiles"), F.monotonically_increasing_id().alias("slot")), "slots")
    tiled = big.join(slots, ["label", "dim"]).select("slot", F.pmod(F.xxhash64("node"), "tiles").alias("tile"), "dim", "node", "cnt", "vec")
    total = slots.agg(F.sum("tiles"), F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2)).first()
    tiled.repartition(int(min(total[0], 20_000)), "slot", "tile").write.partitionBy("slot", "tile").parquet(path)
    span = lambda a: F.explode(F.sequence(F.lit(a) if isinstance(a, int) else F.col(a), F.col("tiles") - 1))
    pairs = slots.select("slot", "tiles", span(0).alias("ta")).select("slot", "ta", span("ta").alias("tb"))

    def load(slot: int, tile: int) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/slot={slot}/tile={tile}", allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]
        return pa.concat_tables(tables) if tables else None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            for slot, ta, tb in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                tables = [t for t in (load(slot, k) for k in sorted({ta, tb})) if t is not None]
                if len(tables) < len({ta, tb}):  # the hash left a tile empty
                    continue
                both = pa.concat_tables(tables)
                x = _units(both["vec"].to_pylist(), [both["dim"][0].as_py()])
                yield from _forest(both["node"].to_numpy(), both["cnt"].to_numpy(), near_pairs(x, tables[0].num_rows, cosine)).to_batches()
                trim()

    return pairs.repartition(int(min(total[1], 50_000))).mapInArrow(run, _FOUND)


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept)."""
    ship(vectors.sparkSession)
    key = ["label", "dim", "f1", "f2"]
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    every = materialize(_prepare(rows), "vectors")
    own = every.where("vec IS NOT NULL").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.first("vec").alias("vec"))
    own = materialize(own.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = materialize(own.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "labels")
    large, labels = sizes.where(F.col("n") > TILE), sizes.count()
    many = large.limit(1).count() > 0
    small = own.join(large, ["label", "dim"], "left_anti") if many else own
    small = small.select("label", "dim", "node", "cnt", "vec").repartition(max(8, min(2 * labels, 20_000)), "label", "dim")
    found = small.groupBy("label", "dim").applyInArrow(_whole(cosine), _FOUND)
    if many:
        found = found.unionByName(_by_tiles(own.join(large, ["label", "dim"], "left_semi"), large, cosine))
    found = materialize(found, "found")
    comps = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = comps.join(own.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    comps = comps.join(least, "component").select("node", "least")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = own.select(*key, "rep", "cnt", "node").join(links, "node", "left").join(comps, "node", "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("links"), F.coalesce("least", "rep").alias("component"))
    out = every.select("id", *key).join(named, key, "left")
    real = lambda c: F.when(c != NO_ID, c)
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(real(F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), (F.col("id") == component).alias("kept"))
