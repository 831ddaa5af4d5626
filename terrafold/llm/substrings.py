"""Substring dedup by recompression.

Documents are rewritten in rounds: first every run of one symbol is named, then symbols are split by a hash
into left and right letters and every left-right pair is named. Names are 64-bit hashes of what they stand
for, so they are global without a table, and equal substrings get equal symbols except near their ends:
what a round does to two neighbours depends on these two alone. For a window of W words the symbols that its
own words determine are known whatever stands around it. The window's anchor is the least of them on
the highest level that has any; equal windows have equal anchors.

Two corpus-wide rounds follow the naming (see batches for how they travel). The first counts anchors: one
that a single document has ends the search for its windows. The second looks only at windows whose anchor is
shared, verifies them by 96 bits of hashes of all their words, and finds the least document that has each.
A word is removed if a window that covers it also starts in a document with a smaller id.

Cases: a null or empty text has no words; a null id is larger than all others and stays null; rows with equal
ids don't remove each other's words; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrafold.llm.batches import FAN, NO_ID, ROWS, Fold, buckets_for, by_bucket, distinct_pairs, exchange, fresh, load_batch, load_rows, pack, pack_check, pack_ints, pack_keys, rows_of, tasks_for, trim, unpack_ints
from terrafold.llm.words import combine, distinct, find_words, hash_words, join_texts, mix, numbered

_U = np.uint64
WINDOW, CHUNK = 13, 1 << 16
_SIGN = _U(1 << 63)
_CHECK = _U(0x3C6EF372FE94F82B)


def rounds_for(window: int) -> int:
    """Rounds after which a window without runs still has a symbol that it determines."""
    n, size = 0, window
    while (size := -(-(size - 4) // 2)) >= 1:
        n += 1
    return n


def compress(names: np.ndarray, first: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: new names, new first symbols of the documents, run of each symbol, class of each run, symbol of each run."""
    n = len(names)
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = True
    head = edge[:n].copy()
    head[1:] |= names[1:] != names[:-1]
    run_of = np.cumsum(head, dtype=np.int32) - 1
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, n))
    runs = names[start]
    long = np.flatnonzero(size > 1)
    runs[long] = combine(runs[long], size[long].astype(_U))
    right = (mix(runs ^ _U(0xA24BAED4963EE407 + round_)) & _U(1)).astype(bool)
    second = np.zeros(len(runs), dtype=bool)
    if len(runs):
        second[1:] = ~right[:-1] & right[1:] & ~edge[start[1:]]
    symbol_of = np.cumsum(~second, dtype=np.int32) - 1
    kept = np.flatnonzero(~second)
    out = runs[kept]
    pairs = np.flatnonzero(second)
    out[symbol_of[pairs]] = combine(runs[pairs - 1], runs[pairs])
    ends = np.append(symbol_of, len(out))[np.append(run_of, len(runs))] if n else np.zeros(1, dtype=np.int64)
    return out, ends[first], run_of, right, symbol_of


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for short ranges, none of them empty."""
    out = values[lo]
    live, at = np.flatnonzero(hi - lo > 1), lo
    step = 1
    while len(live):
        out[live] = np.minimum(out[live], values[at[live] + step])
        step += 1
        live = live[hi[live] - at[live] > step]
    return out


def anchors(names: np.ndarray, first: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window that starts at one of the words at."""
    levels = []
    for r in range(rounds_for(window)):
        below = names
        names, first, run_of, right, symbol_of = compress(below, first, r)
        levels.append((mix(names), run_of, right, symbol_of))
        if not r:
            words = mix(below)
    if not levels:
        words = mix(names)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, len(at), CHUNK):
        out[k : k + CHUNK] = _anchors(words, levels, at[k : k + CHUNK].astype(np.int64), window)
    return out


def _anchors(words: np.ndarray, levels: list[tuple], at: np.ndarray, window: int) -> np.ndarray:
    lo, hi, live = at, at + window, np.arange(len(at))
    found = [(words, lo, hi, live)]
    for names, run_of, right, symbol_of in levels:
        # the outer runs may go on outside; then an outer letter may be taken by a neighbour outside
        lo, hi = run_of[lo] + 1, run_of[hi - 1]
        ok = lo < hi
        lo, hi, live = lo[ok], hi[ok], live[ok]
        lo, hi = lo + right[lo], hi - ~right[hi - 1]
        ok = lo < hi
        lo, hi, live = symbol_of[lo[ok]], symbol_of[hi[ok] - 1] + 1, live[ok]
        found.append((names, lo, hi, live))
    out = np.zeros(len(at), dtype=np.uint64)
    done = np.zeros(len(at), dtype=bool)
    for level in range(len(found) - 1, -1, -1):
        names, lo, hi, live = found[level]
        todo = ~done[live]
        if todo.any():
            who = live[todo]
            out[who] = mix(_least(names, lo[todo], hi[todo]) + _U(level))
            done[who] = True
    return out


def grams(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window words from each of at."""
    out, offset, bit, power = np.full(len(at), window, dtype=np.uint64), 0, 1, names
    while bit <= window:
        if window & bit:
            out = combine(out, power[at + offset])
            offset += bit
        bit *= 2
        if bit <= window:
            half = bit // 2
            power = combine(power[: len(power) - half], power[half:]) if len(power) > half else power[:0]
    return out


class Parsed:
    """A batch's documents with their words and windows."""

    def __init__(self, payload: bytes, window: int) -> None:
        self.ids, self.texts = load_batch(payload)
        data, at = join_texts(self.texts)
        starts, ends, self.first = find_words(data, at)
        self.names = hash_words(data, starts, ends)
        del data, starts, ends
        self.words = np.diff(self.first)
        spare = np.maximum(self.words - window + 1, 0)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), spare)
        begin = np.concatenate([[0], np.cumsum(spare)])[:-1]
        self.at = np.arange(spare.sum(), dtype=np.int32) + np.repeat((self.first[:-1] - begin).astype(np.int32), spare)
        self.anchor = anchors(self.names, self.first, self.at, window)


def _order(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(_U) ^ _SIGN


class _Shared(Fold):
    """Round one: which anchors more than one document has. Batches send a bit for anchors that they have twice."""

    def decode(self, extra: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(extra, np.uint8), count=n)

    def encode(self, values: np.ndarray) -> bytes:
        return np.packbits(values).tobytes()

    def fold(self, values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(where, weights=1 + values.astype(np.float64), minlength=n) > 1


class _Earliest(Fold):
    """Round two: the least document of each window."""

    def fold(self, values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        least = np.full(n, _U(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(least, where, values)
        return least


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text): text has the kept words, joined by one space."""
    return _dedup(docs, id_col, text_col, window, False)


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with repeated words removed and their other columns; a text that loses no word stays as it is."""
    return _dedup(docs, id_col, text_col, window, True)


def _dedup(docs: DataFrame, id_col: str, text_col: str, window: int, whole: bool) -> DataFrame:
    """whole: return the documents' own columns, and texts that lose no word as they are."""
    packed = pack(docs, id_col, text_col, carry=whole)
    names = docs.columns
    batches, tasks = tasks_for(packed)
    # a batch sends to buckets of the first step; the key space may have more
    total = buckets_for(packed)
    buckets = min(total, FAN)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            for batch, payload in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                p = Parsed(payload, window)
                # an anchor and its document, once; then anchors of several documents
                own = np.ones(len(p.anchor), dtype=bool)
                own[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.doc[1:] != p.doc[:-1])
                anchor, doc = p.anchor[own], p.doc[own]
                keys, where = numbered(anchor)
                low, high = np.full(len(keys), len(p.ids)), np.full(len(keys), -1)
                np.minimum.at(low, where, doc)
                np.maximum.at(high, where, doc)
                twice = low < high
                yield rows_of([(b, batch, 0, pack_keys(keys[s]), b"", np.packbits(twice[s]).tobytes()) for b, s in by_bucket(keys, buckets)])
                del p, own, anchor, doc, keys, where, low, high, twice
                trim()

    def candidates(payload: bytes, answers: dict[int, bytes]) -> tuple[Parsed, np.ndarray]:
        p = Parsed(payload, window)
        keys = distinct(p.anchor)
        shared = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=s.stop - s.start) for b, s in by_bucket(keys, buckets)]
        hit = np.concatenate(shared).astype(bool) if shared else np.zeros(0, dtype=bool)
        return p, np.flatnonzero(hit[np.searchsorted(keys, p.anchor)]) if len(keys) else np.zeros(0, dtype=np.int64)

    def windows(p: Parsed, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """96 bits of the words of each distinct candidate window, and where each candidate is among them."""
        at = p.at[cand].astype(np.int64)
        key = grams(p.names, at, window)
        check = (grams(mix(p.names ^ _CHECK), at, window) >> _U(32)).astype(np.uint32)
        return distinct_pairs(key, check)

    def tidy(fn):
        """fn, giving its memory back when it is done."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            fresh()
            out = fn(left, right)
            trim()
            return out

        return run

    def of_round(right: pa.Table, round_: int) -> dict[int, bytes]:
        return {b: a for b, r, a in zip(right["bucket"].to_pylist(), right["round"].to_pylist(), right["answer"].to_pylist(), strict=True) if r == round_}

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        p, cand = candidates(left["payload"][0].as_py(), of_round(right, 1))
        keys, check, where = windows(p, cand)
        least = np.full(len(keys), _U(0xFFFFFFFFFFFFFFFF))
        np.minimum.at(least, where, _order(p.ids)[p.doc[cand]])
        rows = [(b, left["batch"][0].as_py(), 0, pack_keys(keys[s]), pack_check(check[s]), pack_ints(least[s])) for b, s in by_bucket(keys, buckets)]
        return pa.Table.from_batches([rows_of(rows)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        p, cand = candidates(left["payload"][0].as_py(), of_round(right, 1))
        gone = np.zeros(len(p.names) + 1, dtype=np.int32)
        if len(cand):
            keys, _, where = windows(p, cand)
            found = of_round(right, 2)
            least = np.concatenate([unpack_ints(found[b]) for b, _ in by_bucket(keys, buckets)])
            hit = p.at[cand[least[where] < _order(p.ids)[p.doc[cand]]]].astype(np.int64)
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), p.first[:-1]) * (p.words > 0) if len(p.ids) else np.zeros(0, np.int64)
        out = []
        for i, t in enumerate(p.texts):
            if whole and not removed[i]:
                out.append(t)
                continue
            words = t.split() if t else []
            if removed[i]:
                words = [w for w, c in zip(words, covered[p.first[i] : p.first[i + 1]].tolist(), strict=True) if not c]
            out.append(b" ".join(words))
        if whole:
            rest = load_rows(left["extra"][0].as_py())
            text = pa.array(out, pa.binary()).cast(pa.string())
            others = iter(rest.columns)
            return pa.table([text if c == text_col else next(others) for c in names], names=names)
        keys = pa.array(p.ids, pa.int64(), mask=p.ids == NO_ID)
        return pa.table({"doc_id": keys, "n_words": pa.array(p.words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(out, pa.binary()).cast(pa.string())})

    rows = packed.select("batch", "payload")
    of_step = lambda answers, k: answers.where("batch >= 0").select("bucket", "batch", F.lit(k).alias("round"), "answer")
    met = lambda df: df.repartition(tasks, "batch").groupBy("batch")
    one = of_step(exchange(rows.mapInArrow(count, ROWS), buckets, total, batches, _Shared(), "anchors"), 1)
    found = met(rows).cogroup(met(one)).applyInArrow(tidy(verify), ROWS)
    two = of_step(exchange(found, buckets, total, batches, _Earliest(), "windows", write=False), 2)
    both = met(one.unionByName(two))
    if not whole:
        return met(rows).cogroup(both).applyInArrow(tidy(finish), "doc_id long, n_words long, n_removed long, text string")
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields])
    return met(packed.select("batch", "payload", "extra")).cogroup(both).applyInArrow(tidy(finish), schema)
