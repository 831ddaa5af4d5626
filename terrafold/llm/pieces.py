"""SentencePiece encoding by sampling, and decoding.

A text's segmentations into a model's pieces form a lattice over its bytes. Forward filtering sums the weights
exp(alpha * score) of all ways to reach each byte; backward sampling walks from the end and takes each arc
with its share. The random numbers are hashes of the row's key, the unit's place in the text and the step, so
a row always gets the same segmentation, whatever the partitions.

White space that no piece of the model has after another character cannot be inside a piece's word, so the lattice falls
apart into units of such white space and what follows it. Lattices are built for the distinct units of a slice of texts, on arrays; every
occurrence is sampled by itself.

Decoding is lossless: a piece stands for its text with spaces for the model's space mark, characters without a
piece (such as the mark itself) are written as byte pieces, and the one space put before a text is dropped again.

Cases: a null or empty text has no pieces; a null id is a key of its own; repeated rows get the same pieces;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.batches import NO_ID
from terrafold.llm.tokens import _ranges
from terrafold.llm.words import SPACE, combine, find_words, hash_words, join_texts, mix
from terrafold.session import ship

ALPHA, SEED, SLICE_BYTES = 0.002, 20_240_607, 3 << 19
_MARK = "▁"
_U = np.uint64


def unit_space(pieces: list[bytes]) -> np.ndarray:
    """The bytes that units begin with: white space that no piece has after anything else (such as a carriage return after a semicolon)."""
    space = SPACE.copy()
    while True:
        inner = {b for text in pieces for a, b in zip(text, text[1:], strict=False) if space[b] and not space[a]}
        if not inner:
            return space
        if 10 in inner:  # documents are set apart by it
            raise ValueError("the model has pieces that go on over a line's end")
        space[list(inner)] = False


class PieceModel:
    """Pieces of a model as a trie over bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.surface = [b""] * n
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        pieces: list[tuple[bytes, int, float]] = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace(_MARK, " ").encode()
                self.surface[i] = text
                pieces.append((text, i, sp.get_score(i)))
        self.space = unit_space([text for text, _, _ in pieces])
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.byte_score = min(s for _, _, s in pieces) - 10.0
        node: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for text, i, score in pieces:
            at = 0
            for b in text:
                at = node.setdefault((at, b), len(node) + 1)
            if at not in ends or ends[at][1] < score:
                ends[at] = (i, score)
        keys = np.array([a * 256 + b for a, b in node], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(node.values()), dtype=np.int64)[order]
        self.end_id = np.full(len(node) + 1, -1, dtype=np.int64)
        self.end_score = np.zeros(len(node) + 1)
        for at, (i, score) in ends.items():
            self.end_id[at], self.end_score[at] = i, score
        self.first = np.full(256, -1, dtype=np.int64)
        root = np.flatnonzero(self.keys < 256)
        self.first[self.keys[root]] = self.next[root]
        sizes = np.array([len(s) for s in self.surface], dtype=np.int64)
        self.surface_size, self.surface_start = sizes, np.cumsum(sizes) - sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text whose pieces these are."""
        raw = self.surface_bytes[_ranges(self.surface_start[ids], self.surface_size[ids])].tobytes()
        return raw[1:]

    def arcs(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, score) of all arcs over the bytes; limit is where each byte's unit ends."""
        start = np.arange(len(data))
        state = self.first[data]
        found = []
        at, step = start, 1
        live = state >= 0
        at, state = at[live], state[live]
        while len(at):
            done = self.end_id[state] >= 0
            found.append((at[done], at[done] + step, self.end_id[state[done]], self.end_score[state[done]]))
            more = at + step < limit[at]
            at, state = at[more], state[more]
            key = state * 256 + data[at + step]
            spot = np.searchsorted(self.keys, key).clip(0, len(self.keys) - 1)
            ok = self.keys[spot] == key
            at, state = at[ok], self.next[spot[ok]]
            step += 1
        # characters without a piece of their own go byte by byte
        width = np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))
        need = width > 0
        for s, e, _, _ in found:
            need[s[e - s == width[s]]] = False
        lone = _ranges(np.flatnonzero(need), width[need])
        found.append((lone, lone + 1, self.byte_ids[data[lone]], np.full(len(lone), self.byte_score)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def sample(self, texts: list[bytes | None], keys: np.ndarray, alpha: float = ALPHA, seed: int = SEED) -> list[np.ndarray]:
        """The sampled piece ids of each text."""
        texts = [b" " + t if t else b"" for t in texts]
        data, at = join_texts(texts)
        starts, ends, first = find_words(data, at, self.space)
        words = np.diff(first)
        # units: white space with the word after it; what follows the last word is one too
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
        begin[first[:-1][words > 0]] = at[:-1][words > 0]
        last = at[:-1].copy()
        last[words > 0] = ends[first[1:][words > 0] - 1]
        tail = np.flatnonzero(last < at[1:] - 1)
        begin, ends = np.insert(begin, first[1:][tail], last[tail]), np.insert(ends, first[1:][tail], at[1:][tail] - 1)
        first = first + np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(texts)))])
        count = np.diff(first)
        if not len(begin):
            return [np.zeros(0, dtype=np.int64) for _ in texts]
        # neighbours with equal hashes of 128 bits are equal units
        hashes, checks = hash_words(data, begin, ends), hash_words(data, begin, ends, 0x2545F491)
        order = np.argsort(hashes)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]
        size = ends[one] - begin[one]
        local = data[_ranges(begin[one], size)]
        unit_end = np.cumsum(size)
        # node k of a unit is the place after its k-th byte; node 0 of unit i is unit_end[i-1] + i
        limit = np.repeat(unit_end, size)
        shift = np.repeat(np.arange(len(size)), size)
        s, e, ids, score = self.arcs(local, limit)
        a, b = s + shift[s], e + shift[s]
        depth = e - (unit_end - size)[shift[s]]
        order = np.argsort(depth * (len(local) + len(size) + 1) + b, kind="stable")  # arcs of a node by length
        a, b, ids, w, depth = a[order], b[order], ids[order], alpha * score[order], depth[order]
        reach = np.zeros(len(local) + len(size))
        share = np.empty(len(a))
        head = np.concatenate([[0], np.flatnonzero(np.diff(b) != 0) + 1])
        cut = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        mark = np.searchsorted(head, cut)
        for k in range(len(cut) - 1):
            lo, hi = cut[k], cut[k + 1]
            if lo == hi:
                continue
            h = head[mark[k] : mark[k + 1]] - lo
            x = reach[a[lo:hi]] + w[lo:hi]
            top = np.maximum.reduceat(x, h)
            n = np.diff(np.append(h, hi - lo))
            y = np.exp(x - np.repeat(top, n))
            total = np.add.reduceat(y, h)
            reach[b[lo:hi][h]] = top + np.log(total)
            run = y / np.repeat(total, n)
            more, r = h[n > 1], 1
            while len(more):  # summed within the node, so that no other text's numbers leave a trace
                run[more + r] += run[more + r - 1]
                r += 1
                more = h[n > r]
            share[lo:hi] = run
        share[np.append(head[1:], len(share)) - 1] = 2.0  # the last arc takes what rounding leaves
        arc = np.zeros(len(reach), dtype=np.int64)
        arc[b[head]] = head
        # backward sampling of all occurrences at once
        owner = np.repeat(np.arange(len(texts)), count)
        place = (np.arange(len(owner)) - first[owner]).astype(_U)
        base = combine(mix(keys.view(_U) + _U(seed))[owner], place)
        zero = (unit_end - size + np.arange(len(size)))[kind]
        here = (unit_end + np.arange(len(size)))[kind]
        live, steps, step = np.arange(len(owner)), [], 0
        length = np.zeros(len(owner), dtype=np.int64)
        while len(live):
            u = (mix(base[live] + _U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
            pick = arc[here[live]]
            todo = np.flatnonzero(u >= share[pick])
            while len(todo):
                pick[todo] += 1
                todo = todo[u[todo] >= share[pick[todo]]]
            steps.append((live, ids[pick]))
            length[live] += 1
            here[live] = a[pick]
            live = live[here[live] != zero[live]]
            step += 1
        stop = np.cumsum(length)
        out = np.empty(int(stop[-1]), dtype=np.int64)
        for k, (who, piece) in enumerate(steps):
            out[stop[who] - 1 - k] = piece
        edge = np.concatenate([[0], stop])[first]
        return [out[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model for a file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    for rb in frames:
        ids, texts, size = [], [], 0
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 0
            if size >= SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _keys(ids: list) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, ids)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ids, texts in _slices(frames):
            got = m.sample(texts, _keys(ids), alpha, seed)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, text); null ids give a null text."""
    ship(encoded.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rb in frames:
            texts = [m.decode(np.array(x.as_py(), dtype=np.int64)).decode() if x.is_valid else None for x in rb.column(1)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_pieces, ids_crc32, lossless): encodes, decodes and compares without keeping the ids."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for ids, texts in _slices(frames):
            got = m.sample(texts, _keys(ids), alpha, seed)
            crc = [zlib.crc32(g.astype("<u4").tobytes()) for g in got]
            same = [m.decode(g) == (t or b"") for g, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
