"""Documents packed in batches, and lookups that gather keys of all batches.

A statistic over the whole corpus (how often an n-gram occurs, in which document it occurs first) is
wanted back where it occurs. A row per occurrence would shuffle many times the corpus. Here documents are
packed into batches of bounded bytes, written once to the shared folder. Every batch sends each of its
distinct keys once, sorted, a compressed blob for each bucket of the key space; the bucket answers with a
blob in the same order, and the batch's own text meets the answers by batch number. A key is in a batch's
blobs at most once, so one hot key adds one entry for each batch, never one for each row.

A batch sends to FAN buckets at most. A key space of more buckets is reached in steps: the blobs of FAN batches for
one bucket are merged (as many keys as one batch has) and sent on to FAN parts of that bucket, and the answers
return the same way. So rows are in proportion to batches, whatever the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.words import numbered
from terrafold.session import materialize, plan_bytes, ship

#: Text bytes and documents that close a batch; a longer document is a batch of its own.
BATCH_BYTES, BATCH_DOCS = 6 << 20, 8192
#: Buckets that a batch sends to, and batches whose blobs are merged before they are sent on. A power of two.
FAN = 1024
#: Stands for a null id: it is larger than all others.
NO_ID = np.iinfo(np.int64).max


def trim() -> None:
    """Give freed memory back to the system: workers live on after their task, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh() -> None:
    """Drop what other operators keep in this worker between their tasks."""
    for name, held in (("tokens", "_ENCODERS"), ("pieces", "_MODELS")):
        kept = getattr(sys.modules.get(f"terrafold.llm.{name}"), held, None)
        if kept:
            kept.clear()
            gc.collect()
            trim()


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, byte planes apart, so that equal high bytes nearly vanish."""
    v = np.ascontiguousarray(values, dtype="<u8")
    planes = v.view(np.uint8).reshape(-1, 8)
    top = int(v.max()).bit_length() if len(v) else 0
    used = max(1, (top + 7) // 8) if len(v) else 0
    return bytes([used]) + squeeze(np.ascontiguousarray(planes[:, :used].T).tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    used = blob[0]
    if not used:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(unsqueeze(blob[1:]), dtype=np.uint8)
    n = len(raw) // used
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :used] = raw.reshape(used, n).T
    return out.view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their differences."""
    return (keys[:1].astype("<u8").tobytes() + pack_ints(np.diff(keys))) if len(keys) else b""


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(blob[:8], dtype="<u8"), unpack_ints(blob[8:])]), dtype=np.uint64)


def dump_batch(ids: list[int | None], texts: list[bytes | None], level: int = 3) -> bytes:
    n = len(ids)
    head = np.array([n], dtype="<i8").tobytes() + np.array([NO_ID if i is None else i for i in ids], dtype="<i8").tobytes()
    sizes = np.array([-1 if t is None else len(t) for t in texts], dtype="<i8").tobytes()
    return squeeze(head + sizes + b"".join(t for t in texts if t), level)


def load_batch(payload: bytes) -> tuple[np.ndarray, list[bytes | None]]:
    raw = unsqueeze(payload)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    ids = np.frombuffer(raw, dtype="<i8", count=n, offset=8)
    sizes = np.frombuffer(raw, dtype="<i8", count=n, offset=8 + 8 * n)
    texts, at = [], 8 + 16 * n
    for s in sizes.tolist():
        texts.append(None if s < 0 else raw[at : at + s])
        at += max(s, 0)
    return ids, texts


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Callable[[np.ndarray], np.ndarray] | None = None, carry: bool = False) -> DataFrame:
    """Rows (batch, part, payload, extra), written to the shared folder.

    split, if given, maps ids to small numbers; documents of different numbers go to different batches,
    whose rows carry the number in part. carry: extra has the batch's whole rows but for their text, as an Arrow
    stream, so that they need no join later.
    """
    ship(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        base = TaskContext.get().partitionId() << 32
        made = 0
        held: dict[int, tuple[list, list, list, list]] = {}

        def close(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, texts, _, rows = held.pop(part)
            made += 1
            return pa.RecordBatch.from_pydict({"batch": [base + made], "part": pa.array([part], pa.int32()), "payload": [dump_batch(ids, texts)], "extra": [dump_rows(rows) if carry else None]})

        for rb in frames:
            ids = rb.column(0).to_pylist()
            texts = rb.column(1)
            parts = split(rb.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)).tolist() if split else [0] * len(ids)
            begun = dict.fromkeys(held, 0)  # where the rows of open batches begin in this frame
            for i, part in enumerate(parts):
                t = texts[i].as_py()
                own = held.setdefault(part, ([], [], [0], []))
                begun.setdefault(part, i)
                own[0].append(ids[i])
                own[1].append(t)
                own[2][0] += len(t) if t else 0
                if own[2][0] >= BATCH_BYTES or len(own[0]) >= BATCH_DOCS:
                    own[3].append(_cut(rb, begun.pop(part), i + 1))
                    yield close(part)
            if carry:
                for part, i in begun.items():
                    if i < len(ids):
                        held[part][3].append(_cut(rb, i, len(ids)))
        for part in sorted(held):
            yield close(part)
        trim()

    if carry and split:
        raise ValueError("whole rows are carried for undivided batches only")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"), *([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col] if carry else []))
    return materialize(rows.mapInArrow(run, "batch long, part int, payload binary, extra binary"), "packed")


def _cut(rb: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
    """Rows of the carried columns, copied: a slice would hold on to the frame's texts."""
    return rb.select(list(range(2, rb.num_columns))).take(pa.array(range(start, stop), pa.int64()))


def dump_rows(frames: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frames[0].schema) as out:
        for rb in frames:
            out.write_batch(rb)
    return squeeze(sink.getvalue().to_pybytes(), 3)


def load_rows(extra: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(extra)).read_all()


def buckets_for(packed: DataFrame, least: int = 64) -> int:
    """How many buckets of the key space, a power of two: in proportion to the packed bytes, each bucket's keys within one task's memory."""
    total = plan_bytes(packed)
    return 1 << (max(least, total // min(16 << 20, max(3 << 20, total // 1000)) + 1) - 1).bit_length()


def tasks_for(packed: DataFrame) -> tuple[int, int]:
    """Number of batches, and of the tasks that batches are dealt to when they meet their answers."""
    n = packed.count()
    return n, min(max(8, n // 3), 1 << 16)


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """keys are sorted; buckets are the n equal ranges of the 64-bit space, n a power of two."""
    if not len(keys):
        return
    number = keys >> np.uint64(64 - (n.bit_length() - 1)) if n > 1 else np.zeros(len(keys), dtype=np.uint64)
    edge = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(number[a]), slice(a, b)


ROWS = "bucket long, batch long, part int, keys binary, check binary, extra binary"
ANSWER = "bucket long, batch long, part int, answer binary, types long, tokens long"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ROWS."""
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])


def answers_of(rows: list[tuple]) -> pa.Table:
    """Rows of ANSWER; the last two columns may be left out."""
    cols = list(zip(*[(*r, 0, 0)[:6] for r in rows], strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in ANSWER.split(", ")])


def distinct_pairs(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and where each is among them."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # different checks of one key: rare
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    where = np.empty(len(k), dtype=np.int32)
    where[order] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return k[head], c[head], where


class Fold:
    """What a bucket does with the values that batches send with a key.

    decode and encode: a blob's values; fold: one value of each key; settle: a tuple of arrays with the answers of
    each key, from the values with the part of each; reply and read: an answer's blob; stats: two sums over keys.
    """

    def decode(self, extra: bytes, n: int) -> np.ndarray:
        return unpack_ints(extra)

    def encode(self, values: np.ndarray) -> bytes:
        return pack_ints(values)

    def fold(self, values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        raise NotImplementedError

    def settle(self, values: np.ndarray, part: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        return (self.fold(values, where, n),)

    def reply(self, answers: tuple[np.ndarray, ...], part: int) -> bytes:
        return self.encode(answers[0])

    def read(self, blob: bytes, n: int, part: int) -> tuple[np.ndarray, ...]:
        return (self.decode(blob, n),)

    def stats(self, keys: np.ndarray, answers: tuple[np.ndarray, ...]) -> tuple[int, int]:
        return 0, 0


class _Gathered:
    """The blobs of one bucket."""

    def __init__(self, table: pa.Table, fold: Fold) -> None:
        self.rows = sorted(zip(*(table[c].to_pylist() for c in ("batch", "bucket", "part", "keys", "check", "extra")), strict=True))
        keys = [unpack_keys(r[3]) for r in self.rows]
        sizes = [len(k) for k in keys]
        edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.slices = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.values = np.concatenate([fold.decode(r[5], n) for r, n in zip(self.rows, sizes, strict=True)])
        self.part = np.repeat(np.array([r[2] for r in self.rows]), sizes)
        flat = np.concatenate(keys)
        if self.rows[0][4]:
            check = np.concatenate([np.frombuffer(unsqueeze(r[4]), dtype="<u4") for r in self.rows])
            self.keys, self.check, self.where = distinct_pairs(flat, check)
        else:
            self.keys, self.where = numbered(flat)
            self.check = None


def pack_check(check: np.ndarray | None) -> bytes:
    return b"" if check is None else squeeze(check.astype("<u4").tobytes())


def exchange(emitted: DataFrame, at: int, buckets: int, batches: int, fold: Fold, tag: str, write: bool = True) -> DataFrame:
    """Rows of ANSWER, written unless they are read once only: for every row of emitted (ROWS, dealt to at buckets) the answers of its keys, in their order.

    Rows with batch -1 hold the stats of a bucket.
    """

    def settle(table: pa.Table) -> pa.Table:
        g = _Gathered(table, fold)
        answers = fold.settle(g.values, g.part, g.where, len(g.keys))
        out = [(g.rows[0][1], -1, 0, b"", *fold.stats(g.keys, answers))]
        for (batch, bucket, part, *_), s in zip(g.rows, g.slices, strict=True):
            out.append((bucket, batch, part, fold.reply(tuple(a[g.where[s]] for a in answers), part)))
        return answers_of(out)

    if at >= buckets:
        got = emitted.repartition(min(at, max(8, batches), 20_000), "bucket").groupBy("bucket").applyInArrow(settle, ANSWER)
        return materialize(got, tag) if write else got
    fine, groups = min(buckets, at * FAN), -(-batches // FAN)
    keys = ["bucket", "part", "grp"]
    emitted = materialize(emitted.withColumn("grp", F.pmod(F.xxhash64("batch"), F.lit(groups))), f"{tag}up")

    def merge(table: pa.Table) -> pa.Table:
        g = _Gathered(table, fold)
        values, (_, _, part, *_) = fold.fold(g.values, g.where, len(g.keys)), g.rows[0]
        out = [(b, table["grp"][0].as_py(), part, pack_keys(g.keys[s]), pack_check(None if g.check is None else g.check[s]), fold.encode(values[s])) for b, s in by_bucket(g.keys, fine)]
        return pa.Table.from_batches([rows_of(out)])

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        g = _Gathered(left, fold)
        found = {b: a for b, a in zip(right["bucket"].to_pylist(), right["answer"].to_pylist(), strict=True)}
        read = [fold.read(found[b], s.stop - s.start, g.rows[0][2]) for b, s in by_bucket(g.keys, fine)]
        answers = tuple(np.concatenate(x) for x in zip(*read, strict=True))
        return answers_of([(bucket, batch, part, fold.reply(tuple(a[g.where[s]] for a in answers), part)) for (batch, bucket, part, *_), s in zip(g.rows, g.slices, strict=True)])

    n = min(at * groups, 20_000)
    up = emitted.repartition(n, *keys).groupBy(*keys)
    got = exchange(up.applyInArrow(merge, ROWS), fine, buckets, groups, fold, f"{tag}+")
    home = F.floor(F.col("bucket") / (fine // at)).cast("long").alias("home")
    down = got.where("batch >= 0").select(home, "part", F.col("batch").alias("grp"), "bucket", "answer")
    back = up.cogroup(down.repartition(n, "home", "part", "grp").groupBy("home", "part", "grp")).applyInArrow(spread, ANSWER)
    return (materialize(back, tag) if write else back).unionByName(got.where("batch < 0"))
