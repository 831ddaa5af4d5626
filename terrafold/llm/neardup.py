"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles (lower-cased A-Z). A sketch has M registers; each is the
largest floor(1 - log_b(e)) over the set, e exponential with rate A, cut off to 0..Q + 1: the least hash of
the set on an exponential scale. Registers of a union are the larger of each, and two registers are equal
with a probability that is close to the Jaccard similarity, since b is close to 1.

Documents with equal sets are one class; the least id represents it. Bands of registers give buckets.
In a bucket every member is compared with the least one (a star: as many pairs as members). A pair is kept
if the likelihood of its register comparisons, given both set sizes, has its maximum near enough to the
threshold, and becomes a link if the full sets confirm it. Where a bucket's members are not in one component
after that, members outside its largest component are compared with all others of the bucket, in tiles that
hold registers and full sets, so that the star loses no link between different sets. With BANDS x ROWS registers a pair at the threshold shares no bucket
with a probability of (1 - 0.8^5)^36 = 6.2e-7; of the others the estimate drops 2.3e-10 (see CUT).

Cases: a null or empty text, or one without words, has an empty set and links with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; a null id is larger than all others and stays
null; repeated rows are of one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.batches import NO_ID, fresh, trim
from terrafold.llm.links import components
from terrafold.llm.words import LOWER, combine, distinct, find_words, hash_words, join_texts, mix
from terrafold.session import materialize, ship

_U = np.uint64
SHINGLE, THRESHOLD = 2, 80
BANDS, ROWS = 36, 5
M = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: A pair at the threshold has fewer equal registers than this share with a probability of 2.3e-10 (binomial tail).
CUT = 0.60
TILE, SLICE_BYTES = 600, 2 << 20
#: Ids up to this many are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 250_000
_MULTIPLIERS = mix(np.arange(1, M + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = join_texts(texts)
    data = LOWER[data]
    starts, ends, first = find_words(data, at)
    h = hash_words(data, starts, ends)
    grams = h
    for k in range(1, shingle):
        grams = combine(grams[:-1], h[k:]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(distinct(grams[a : b - shingle + 1]))
        elif b > a:
            whole = h[a:b].copy()
            for k in range(1, b - a):
                whole[:1] = combine(whole[:1], whole[k : k + 1])
            out.append(mix(whole[:1] + _U(b - a)))
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """M registers for each non-empty set."""
    least = np.empty((M, len(sets)), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    k = 0
    while k < len(sets):  # a few thousand elements at a time stay in the cache
        e = k + max(1, int(np.searchsorted(np.cumsum(sizes[k:]), 40_000)))
        x = np.concatenate(sets[k:e])
        begin = np.concatenate([[0], np.cumsum(sizes[k:e])[:-1]])
        for i in range(M):
            least[i, k:e] = np.minimum.reduceat(x * _MULTIPLIERS[i], begin)
        k = e
    e = -np.log1p(-np.minimum(least.T.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.floor(1 - np.log(np.maximum(e, 1e-300)) / np.log(BASE)).clip(0, Q + 1).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair by maximum likelihood, on a grid; a and b hold registers, na and nb set sizes."""
    plus, minus = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - plus - minus
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = plus[:, None] * log(more) + minus[:, None] * log(less) + same[:, None] * log(1 - more - less)
    return grid[np.arange(len(grid)), fit.argmax(axis=1)]


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """Ids and texts, a bounded number of bytes at a time."""
    for rb in frames:
        ids, texts, size = [], [], 0
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
            ids.append(i)
            texts.append(t.as_py())
            size += len(texts[-1]) if texts[-1] else 0
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, n, f1, f2, regs): set size, 128-bit fingerprint of the set, registers."""

    def part(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        sets = shingle_sets(texts, shingle)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        full = [s for s in sets if len(s)]
        regs = registers(full) if full else np.zeros((0, M), dtype="<u2")
        rows = iter(regs)
        blob = [next(rows).tobytes() if k else None for k in n.tolist()]
        f1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
        f2 = [int(mix(s ^ _U(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(blob, pa.binary())], names=["id", "n", "f1", "f2", "regs"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for ids, texts in _slices(frames):
            yield part(ids, texts)
        trim()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """Rows (key, band, rep, n), one for each band."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            if rb.num_rows:
                regs = np.frombuffer(b"".join(rb.column(2).to_pylist()), dtype="<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
                for r in range(ROWS):
                    key = combine(key, regs[:, :, r])
                rep = np.repeat(rb.column(0).to_numpy(), BANDS)
                band = np.tile(np.arange(BANDS, dtype=np.int32), rb.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(rep), pa.array(np.repeat(rb.column(1).to_numpy(), BANDS))], names=["key", "band", "rep", "n"])

    return reps.select("rep", "n", "regs").mapInArrow(run, "key long, band int, rep long, n long")


def _ratio(na, nb, percent: int):
    """Set sizes further apart than this cannot reach the threshold."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) whose registers make a similarity near the threshold likely."""
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in (frame.slice(k, 2000) for frame in frames for k in range(0, frame.num_rows, 2000)):
            if rb.num_rows:
                a, b = (np.frombuffer(b"".join(rb.column(k).to_pylist()), dtype="<u2").reshape(-1, M) for k in ("ra", "rb"))
                yield rb.select(["a", "b"]).filter(pa.array(estimate(a, b, rb.column("na").to_numpy(), rb.column("nb").to_numpy()) >= CUT))

    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb")
    return joined.mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, s): the full sets of the documents in ids, whose texts are read again. ids is held in a table."""
    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(frames):
            got = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["id", "s"])
        trim()

    return materialize(rows.mapInArrow(run, "id long, s binary"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """pairs whose full sets reach the threshold."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = _sets(ids, docs, id_col, text_col, shingle)

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            keep = []
            for x, y in zip(rb.column("sa"), rb.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a).sum()) if len(a) else 0
                keep.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
            yield rb.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    side = lambda k: sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(meet, "a long, b long").distinct()


def _open_buckets(bands: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that the star left in several components, cut into tiles that meet in pairs.

    Members outside a bucket's largest component are on the left, all members are on the right: those of the
    largest component need no comparison with each other, and are most of a large bucket.
    """
    own = bands.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    each = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    open_ = each.agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component")).alias("major")).where("parts > 1 AND size > 2")
    open_ = open_.select("key", F.col("major.component").alias("major"), F.ceil((F.col("size") - F.col("major.c")) / TILE).alias("lefts"), F.ceil(F.col("size") / TILE).alias("rights"))
    mine = own.join(open_, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    cols = ("key", "band", "rep", "n", "component", (F.col("component") == F.col("major")).alias("main"))
    left = mine.where("component <> major").select(*cols, at("lefts").alias("l"), spread("rights").alias("r"), F.lit(True).alias("first"))
    right = mine.select(*cols, at("rights").alias("r"), spread("lefts").alias("l"), F.lit(False).alias("first"))
    return left.unionByName(right)


def _between(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within tiles: likely by registers, in the first band that a pair shares, and confirmed.

    Pairs that earlier links of the tile have joined are left out, so a tile returns fewer links than members.
    """
    full = members.join(reps.select("rep", "regs"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")

    def run(table: pa.Table) -> pa.Table:
        band = table["band"][0].as_py()
        rep, n, comp, main, first = (table[c].to_numpy() for c in ("rep", "n", "component", "main", "first"))
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), dtype="<u2").reshape(-1, M)
        sets_ = [np.frombuffer(x, dtype="<u8") for x in table["s"].to_pylist()]
        right = np.flatnonzero(~first)
        comp = comp.copy()
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(first).tolist():
            js = right[(comp[right] != comp[i]) & (main[right] | (rep[right] > rep[i])) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            same = regs[js] == regs[i]
            js = js[(same.mean(axis=1) >= CUT - 0.05) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)]
            if len(js):
                js = js[estimate(np.broadcast_to(regs[i], (len(js), M)), regs[js], np.full(len(js), n[i]), n[js]) >= CUT]
            for j in js.tolist():
                if comp[i] == comp[j]:
                    continue
                a, b = sets_[i], sets_[j]
                both = int((b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    out.append((int(rep[i]), int(rep[j])))
                    comp[comp == comp[j]] = comp[i]
        del sets_, regs
        trim()
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return full.groupBy("key", "l", "r").applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept); component_id is the least id reachable by links."""
    ship(docs.sparkSession)
    all_ = materialize(sketch(docs, id_col, text_col, shingle), "sketch")
    reps = materialize(all_.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("regs").alias("regs")), "reps")
    bands = materialize(_bands(reps), "bands")
    hubs = bands.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = bands.join(hubs, "key").where((F.col("rep") != F.col("hub.rep")) & _ratio(F.col("n"), F.col("hub.n"), percent))
    pairs = materialize(star.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    likely = materialize(_likely(pairs, reps), "likely")
    links = materialize(_confirm(likely, docs, id_col, text_col, shingle, percent), "links")
    comps = components(links)
    members = materialize(_open_buckets(bands, comps), "members")
    ids = materialize(members.select(F.col("rep").alias("id")).distinct(), "ids")
    if ids.limit(1).count():
        more = materialize(_between(members, reps, _sets(ids, docs, id_col, text_col, shingle), percent), "links2")
        if more.limit(1).count():
            comps = components(links.union(more))
    named = reps.select("n", "f1", "f2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = all_.select("id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    real = lambda c: F.when(c != NO_ID, c)
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """The documents that represent their component, with their own columns; rows with equal ids stay or go together."""
    judged = classes(docs, id_col, text_col, shingle, percent).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = materialize(judged.where("NOT kept").select(F.col("doc_id").alias("__nd_id")), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__nd_id")), "left_anti")
