"""Binary id files with keyed access: raw ids by shard and a minimal perfect hash index over document keys.

A shard file holds, in ascending key order, the documents' ids without gaps, then the keys, the token
offset of each document, and the index: for n distinct keys a hash-and-displace function onto 0..n-1, and
for each slot the key's fingerprint and the rank of its first document. The manifest, a table, has a row for each shard:
its file, its range of keys, and how many ids the shards before it have. A lookup finds the shard by the manifest's key
ranges and reads the footer, one displacement, one slot and two offsets of it, then the document's ids, whatever the
shard's size; a key that is not there is refused by its fingerprint. A file's name has its task attempt in it, and the
manifest names the files of the attempts that counted.

Layout (little endian): 8 bytes magic; ids (2 or 4 bytes each); keys int64[docs]; starts int64[docs + 1];
displacements int64[buckets]; fingerprints uint64[n]; ranks int64[n]; footer int64[6]: width, docs, tokens,
buckets, n, seed; 8 bytes magic.

Cases: a null or empty text is its end id alone; a null id sorts last and is returned as null; documents
with equal keys lie side by side, and a lookup finds the first; an empty table writes no files and gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.batches import NO_ID
from terrafold.llm.tokens import encoder
from terrafold.llm.words import mix
from terrafold.session import fresh_path, materialize, plan_bytes, ship

MAGIC = b"TFIDS001"
PER_BUCKET, TRIES = 4, 16
#: Bytes of the input for a shard, least and most; between them the input is dealt to SHARDS. Bytes that are read at once.
SHARD_BYTES, MOST_BYTES, SHARDS, BLOCK_BYTES = 8 << 20, 256 << 20, 4096, 4 << 20
_MANIFEST = "shard int, file string, docs long, tokens long, first long, last long"
_U = np.uint64


class PerfectHash:
    """Keys to 0..n-1 without collisions: buckets, largest first, get the first displacement that fits."""

    def __init__(self, n: int, displacements: np.ndarray, seed: int) -> None:
        self.n, self.displacements, self.seed = n, displacements, seed

    @staticmethod
    def _hashes(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix(keys.astype(np.int64).view(_U) ^ mix(np.array([seed], dtype=_U)))
        return a, mix(a + _U(0x9E3779B97F4A7C15))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        m = max(1, -(-n // PER_BUCKET))
        for seed in range(1, 100):
            a, b = cls._hashes(keys, seed)
            bucket = (a % _U(m)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(m + 1))
            size = np.diff(edge)
            taken, disp = np.zeros(n, dtype=bool), np.zeros(m, dtype=np.int64)
            for k in np.argsort(-size, kind="stable").tolist():
                own = b[order[edge[k] : edge[k + 1]]]
                if len(own) < 2:
                    break
                for d in range(0, 1 << 20, TRIES):
                    at = np.sort((mix(own[None, :] + np.arange(d, d + TRIES, dtype=_U)[:, None]) % _U(n)).astype(np.int64), axis=1)
                    fits = ~(taken[at].any(axis=1) | (at[:, 1:] == at[:, :-1]).any(axis=1))
                    if fits.any():
                        hit = int(fits.argmax())
                        taken[at[hit]], disp[k] = True, d + hit
                        break
                else:
                    break
            else:
                k = -1
            if k >= 0 and size[k] > 1:
                continue
            single = np.flatnonzero(size == 1)
            free = np.flatnonzero(~taken)
            disp[single] = -1 - free[: len(single)]  # a bucket of one key names its slot
            return cls(n, disp, seed)
        raise RuntimeError("no perfect hash found; are the keys distinct?")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=np.int64)
        return self.place(keys, self.seed, self.n, self.displacements[self.buckets(keys, self.seed, len(self.displacements))])

    @classmethod
    def buckets(cls, keys: np.ndarray, seed: int, m: int) -> np.ndarray:
        """Whose displacement a key needs."""
        return (cls._hashes(keys, seed)[0] % _U(m)).astype(np.int64)

    @classmethod
    def place(cls, keys: np.ndarray, seed: int, n: int, d: np.ndarray) -> np.ndarray:
        """Slots of keys by their displacements."""
        b = cls._hashes(keys, seed)[1]
        return np.where(d < 0, -1 - d, (mix(b + d.clip(0).astype(_U)) % _U(n)).astype(np.int64))


class Shard:
    """One file, of which only what is asked for is read."""

    def __init__(self, uri: str) -> None:
        fs, name = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        if size < 64 or self.file.read_at(8, 0) != MAGIC:
            raise ValueError("not an id file")
        foot = self.file.read_at(56, size - 56)
        if foot[-8:] != MAGIC:
            raise ValueError("not an id file")
        self.width, self.docs, self.tokens, self.buckets, self.n, self.seed = np.frombuffer(foot, dtype="<i8", count=6).tolist()
        sizes = [self.tokens * self.width, 8 * self.docs, 8 * (self.docs + 1), 8 * self.buckets, 8 * self.n, 8 * self.n]
        self.at = dict(zip(("ids", "keys", "starts", "displacements", "prints", "ranks"), [8 + sum(sizes[:k]) for k in range(6)], strict=True))

    def close(self) -> None:
        self.file.close()

    def words(self, part: str, first: int, n: int) -> np.ndarray:
        """n of a part's 64-bit numbers."""
        return np.frombuffer(self.file.read_at(8 * n, self.at[part] + 8 * first), dtype="<u8" if part == "prints" else "<i8")

    def rank(self, key: int) -> int:
        """The rank of the key's first document, or -1."""
        if not self.n:
            return -1
        k = np.array([key], dtype=np.int64)
        d = self.words("displacements", int(PerfectHash.buckets(k, self.seed, self.buckets)[0]), 1)
        slot = int(PerfectHash.place(k, self.seed, self.n, d)[0])
        return int(self.words("ranks", slot, 1)[0]) if self.words("prints", slot, 1)[0] == fingerprint(k)[0] else -1

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """The same for many keys: the index is read as a whole."""
        if not self.n:
            return np.full(len(keys), -1)
        slot = PerfectHash(self.n, self.words("displacements", 0, self.buckets), self.seed).slots(keys)
        return np.where(self.words("prints", 0, self.n)[slot] == fingerprint(keys), self.words("ranks", 0, self.n)[slot], -1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, self.at["ids"] + start * self.width), dtype=f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the key's first document."""
        rank = self.rank(key)
        return None if rank < 0 else self.ids(*self.words("starts", rank, 2).tolist())


def get(manifest: DataFrame, key: int | None) -> np.ndarray | None:
    """The ids of a key's first document, or None."""
    key = NO_ID if key is None else key
    for row in manifest.where((F.col("first") <= key) & (F.col("last") >= key)).select("file").collect():  # ranges don't overlap: one at most
        shard = Shard(row.file)
        try:
            return shard.get(key)
        finally:
            shard.close()
    return None


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(_U) + _U(0xD1B54A32D192ED03))


def index_bytes(keys: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """All that follows the ids of a shard."""
    distinct, first = np.unique(keys, return_index=True)
    ph = PerfectHash.build(distinct)
    slot = ph.slots(distinct)
    prints, ranks = np.zeros(len(distinct), dtype="<u8"), np.zeros(len(distinct), dtype="<i8")
    prints[slot], ranks[slot] = fingerprint(distinct), first
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    foot = np.array([width, len(keys), starts[-1], len(ph.displacements), len(distinct), ph.seed], dtype="<i8")
    return b"".join((keys.astype("<i8").tobytes(), starts.tobytes(), ph.displacements.astype("<i8").tobytes(), prints.tobytes(), ranks.tobytes(), foot.tobytes(), MAGIC))


def width_of(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id of a tokenizers file, and the end id."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the shards; the manifest (shard, file, docs, tokens, first, last, base), in key order."""
    spark = docs.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "ids")
    width = width_of(tokenizer, end_id)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        shard, enc = ctx.partitionId(), encoder(tokenizer, False)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        fs, root = pafs.FileSystem.from_uri(path)
        name = f"shard-{shard:06d}-{ctx.taskAttemptId()}.ids"
        out, keys, sizes = None, [], []
        try:
            for rb in frames:
                for key, ids in zip(rb.column(0).to_pylist(), enc.encode(rb.column(1).to_pylist()), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC)
                    out.write(ids.astype(f"<u{width}").tobytes() + end)
                    keys.append(NO_ID if key is None else key)
                    sizes.append(len(ids) + 1)
            if out is not None:
                out.write(index_bytes(np.array(keys, dtype=np.int64), np.array(sizes, dtype=np.int64), width))
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            row = {"shard": pa.array([shard], pa.int32()), "file": [f"{path}/{name}"], "docs": [len(keys)], "tokens": [sum(sizes)]}
            yield pa.RecordBatch.from_pydict(row | {"first": pa.array([keys[0]], pa.int64()), "last": pa.array([keys[-1]], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = plan_bytes(docs)
    shards = max(12, total // max(SHARD_BYTES, min(MOST_BYTES, total // SHARDS)) + 1)
    key = F.coalesce(F.col("id"), F.lit(NO_ID))
    rows = rows.repartitionByRange(int(shards), key).sortWithinPartitions(key)
    made = materialize(rows.mapInArrow(run, _MANIFEST), "manifest")
    # a row for each shard, so one task adds them up
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each document, looked up by its key in the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            for file, base in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                shard = Shard(file)
                keys, starts = shard.words("keys", 0, shard.docs), shard.words("starts", 0, shard.docs + 1)
                # documents with equal keys follow the first
                rank = shard.ranks_of(keys) + np.arange(len(keys)) - np.searchsorted(keys, keys)
                first, size = starts[rank], np.diff(starts)[rank]
                block = np.cumsum(size) * shard.width // BLOCK_BYTES
                for k in np.unique(block).tolist():
                    at = slice(*np.searchsorted(block, [k, k + 1]).tolist())
                    low = int(first[at].min())
                    ids = shard.ids(low, int((first[at] + size[at]).max()))
                    crc = [zlib.crc32(ids[a - low : a - low + n].tobytes()) for a, n in zip(first[at].tolist(), size[at].tolist(), strict=True)]
                    cols = [pa.array(keys[at], mask=keys[at] == NO_ID), pa.array(first[at] + base), pa.array(size[at]), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                shard.close()

    return manifest.select("file", "base").repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(run, schema)
