"""Best-fit packing: documents cut into pieces of at most a sequence's length, packed into few sequences.

Pieces are dealt to partitions and packed by best-fit decreasing. Lower bounds from dual-feasible functions
certify bin counts: the whole is done when its count meets the bound of all pieces. Until then bins are exchanged: from a
partition with a gap to its own bound all that are not full, from a certified one those that are not nearly full.
They are dealt to fewer groups, each packs its pieces again and keeps the better result, round after round. A group has
no more than MOST pieces: where open bins are more than one group's, every round deals them anew, whole bins by a hash
of the round, so that bins meet others than before. It ends when the count is certified, when one group is left, or
when a round of groups that cannot be fewer has saved no bin. A row says whether its partition's last packing met its
own bound, and whether all sequences together meet the bound of all pieces.

Cases: a null or empty text is its end id alone; repeated rows are separate documents; an empty table gives
an empty result; other columns are not read. A null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.batches import trim
from terrafold.llm.tokens import encoder
from terrafold.session import materialize, ship

SEQUENCE, END_ID = 2048, 0
#: Pieces dealt to a partition, partitions that merge in a round, the most pieces of a group, and the share of a
#: sequence that a nearly full bin may lack.
PER_PARTITION, MERGE, MOST, NEAR = 8_000, 6, 150_000, 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, written to the shared folder: its place, length and the checksum of its ids."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(tokenizer, True), TaskContext.get().partitionId() << 33
        for rb in frames:
            rows: list[tuple] = []
            for key, ids in zip(rb.column(0).to_pylist(), enc.encode(rb.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    n += 1
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, _PIECES), "pieces")


def lower_bound(counts: np.ndarray, length: int) -> int:
    """The best of the bounds from dual-feasible functions; counts[s] is how many pieces have size s.

    For each threshold e: pieces over length - e count as a whole bin, pieces under e as nothing, the
    rest by size. And for each k: sizes stretched to the grid of k + 1 steps, where they don't lie on it.
    """
    size = np.arange(len(counts), dtype=np.int64)
    total = lambda v: -(-int((counts * v).sum()) // length)
    best = total(size)
    for e in range(1, length // 2 + 1):
        v = np.where(size > length - e, length, np.where(size < e, 0, size))
        best = max(best, total(v))
    for k in range(1, 33):
        x = size * (k + 1)
        v = np.where(x % length == 0, size * k, (x // length) * length)
        best = max(best, -(-int((counts * v).sum()) // (length * k)))
    for e in np.unique(np.flatnonzero(counts)):
        if e <= length // 2 and e:
            # how many pieces of size e fit beside each larger piece
            fit = length // int(e)
            v = np.where(2 * size > length, 2 * (fit - (length - size) // int(e)), np.where(size * 2 == length, fit, 2 * (size // int(e))))
            v = np.where(size == 0, 0, v)
            best = max(best, -(-int((counts * v).sum()) // (2 * fit)))
    return best


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins: best-fit decreasing."""
    bins, at = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_, n = 0, 0  # open_: bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b, n = length, n, n + 1
        bins[i], at[i] = b, length - r
        if r > s:
            room[r - s].append(b)
            open_ |= 1 << (r - s)
    return bins, at, n


def assign(cut: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """cut's rows with sequence_id, offset, part_certified and certified."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    full = cut.where(F.col("length") == length).withColumns({"sequence_id": -F.col("row"), "offset": F.lit(0).cast("long"), "part_certified": F.lit(True)})
    rest = cut.where(F.col("length") < length)
    sizes = {r.length: r.c for r in rest.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most one row a length
    n = sum(sizes.values())
    if not n:
        return full.withColumn("certified", F.lit(True)).drop("row")
    bound = lower_bound(np.array([sizes.get(k, 0) for k in range(length + 1)], dtype=np.int64), length)
    schema = f"{_PIECES}, part long, bin long, offset long, proved boolean, final boolean"

    def packer(again: bool):
        def run(table: pa.Table) -> pa.Table:
            sizes = table["length"].to_numpy()
            bins, at, used = best_fit(sizes, length)
            if again:
                was = np.unique(np.stack([table["old"].to_numpy(), table["bin"].to_numpy()]), axis=1, return_inverse=True)
                if was[0].shape[1] <= used:
                    bins, at, used = was[1].reshape(-1).astype(np.int64), table["offset"].to_numpy(), was[0].shape[1]
            filled = np.bincount(bins, weights=sizes, minlength=used)
            proved = used <= lower_bound(np.bincount(sizes, minlength=length + 1), length)
            final = filled[bins] >= (length - length // NEAR if proved else length)
            out = {k: table[k] for k in names}
            proofs = pa.array(np.full(len(sizes), proved))
            return pa.table(out | {"part": table["part"], "bin": pa.array(bins, pa.int64()), "offset": pa.array(at, pa.int64()), "proved": proofs, "final": pa.array(final)})

        return run

    def packed(rows: DataFrame, parts: int, again: bool, tag: str) -> DataFrame:
        spread = rows.repartition(int(min(parts, 20_000)), "part")  # one exchange, not coalesced: packing is slow for its bytes
        return materialize(spread.groupBy("part").applyInArrow(packer(again), schema), tag)

    parts = max(1, -(-n // PER_PARTITION))
    done, round_, closed, before = [], 0, 0, None
    now = packed(rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), parts, False, "packed0")
    while True:
        round_ += 1
        stats = {r.final: r for r in now.groupBy("final").agg(F.countDistinct("part", "bin").alias("bins"), F.count(F.lit(1)).alias("n")).collect()}  # two rows
        closed += stats[True].bins if True in stats else 0
        open_, total = (stats[False].n, closed + stats[False].bins) if False in stats else (0, closed)
        groups = max(-(-parts // MERGE), -(-open_ // MOST))
        stuck = groups >= parts and before is not None and total >= before
        last = not open_ or parts == 1 or total <= bound or stuck
        done.append((now if last else now.where("final")).select(*names, "offset", F.col("proved").alias("part_certified"), (F.lit(round_).cast("long") * (1 << 56) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id")))
        if last:
            break
        # few groups take whole partitions; groups that can't be fewer take bins, other ones in each round
        to = F.floor(F.col("part") / MERGE) if groups < parts and groups * MERGE >= parts and open_ <= groups * MOST // 2 else F.pmod(F.xxhash64("part", "bin", F.lit(round_)), F.lit(groups))
        moved = now.where(~F.col("final")).withColumn("old", F.col("part")).withColumn("part", F.least(to, F.lit(groups - 1)).cast("long"))
        before = total
        now, parts = packed(moved, groups, True, f"packed{round_}"), groups
    out = full
    for d in done:
        out = out.unionByName(d)
    return out.withColumn("certified", F.lit(total <= bound)).drop("row")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_certified, certified)."""
    out = assign(pieces(docs, tokenizer, id_col, text_col, length, end_id), length)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part_certified", "certified")
