"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of trigrams, bigrams, unigrams and the uniform distribution are mixed step by step:
P1(w) = l1 c(w) / N + (1 - l1) / (V + 1), P2(w | v) = l2[b] c(vw) / c(v) + (1 - l2[b]) P1(w) and P3(w | u v) =
l3[b] c(uvw) / c(uv) + (1 - l3[b]) P2(w | v), b the bucket of the context's count. A context that training texts
don't have passes all weight on, so every mixture sums to one. The weights come from expectation-maximisation on a
part of the training documents that is deleted from the counts meanwhile; the final model counts all training documents.

Counts are exact sums over the whole corpus. Batches of documents send their distinct n-grams with counts,
buckets of the key space add them up and answer (see batches). The estimates of the deleted part's tokens are
written once; a round of expectation-maximisation is one pass over them, which brings two sums for each bucket to
the driver.

Cases: a null or empty text is its end token alone; a null id is in the fold that crc32 of an empty string
gives; repeated rows each count; a document's first token has no trigram; without deleted tokens all weights are a
half; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.batches import FAN, NO_ID, ROWS, Fold, buckets_for, by_bucket, exchange, fresh, load_batch, pack, pack_ints, pack_keys, rows_of, squeeze, tasks_for, trim, unpack_ints, unsqueeze
from terrafold.llm.words import LOWER, combine, find_words, hash_words, join_texts, numbered
from terrafold.session import materialize

_U = np.uint64
FOLDS, HELD_OUT, DELETED = 10, 0, 9
#: Buckets of context counts (powers of two), the most rounds, the change of a weight that ends them, and what counts as seen beforehand.
BUCKETS, ROUNDS, SETTLED, PRIOR = 16, 30, 1e-3, 1.0
_END, _START = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_LOW = _U(0xFF)
#: Low byte of keys: unigrams are odd, the document start is 2, bigrams are 0, trigrams 4.
_END_KEY, _START_KEY = _END | _U(1), (_START & ~_LOW) | _U(2)


def folds(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo FOLDS."""
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS for i in ids.tolist()], dtype=np.int64)


def _part(ids: np.ndarray) -> np.ndarray:
    return (folds(ids) == DELETED).astype(np.int64)


class _Tokens:
    """A batch's tokens: their n-grams among the batch's sorted distinct keys, and where each document's tokens start."""

    def __init__(self, payload: bytes) -> None:
        self.ids, texts = load_batch(payload)
        data, at = join_texts(texts)
        data = LOWER[data]
        starts, ends, first = find_words(data, at)
        one = np.insert(hash_words(data, starts, ends) | _U(1), first[1:], _END_KEY)
        self.begin = first[:-1] + np.arange(len(texts))
        del texts, data, at, starts, ends
        before = np.empty_like(one)
        before[1:] = one[:-1]
        before[self.begin] = _START_KEY
        two = combine(before, one) & ~_LOW
        self.inner = np.ones(len(one), dtype=bool)  # tokens that have a trigram
        self.inner[self.begin] = False
        inner = np.flatnonzero(self.inner)
        three = (combine(two[inner - 1], one[inner]) & ~_LOW) | _U(4)
        n, every = len(one), np.concatenate([one, two, three, [_START_KEY]])
        del one, two, three, before, inner
        self.keys, where = numbered(every)
        del every
        self.one, self.two, self.three, self.start = where[:n], where[n : 2 * n], where[2 * n : -1], where[-1]
        self.before = np.empty(n, dtype=where.dtype)
        self.before[1:] = self.one[:-1]
        self.before[self.begin] = self.start

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often the documents of train have each key."""
        each = np.repeat(train, np.diff(np.append(self.begin, len(self.one))))
        out = np.bincount(self.one[each], minlength=len(self.keys)) + np.bincount(self.two[each], minlength=len(self.keys))
        out += np.bincount(self.three[each[self.inner]], minlength=len(self.keys))
        out[self.start] = train.sum()
        return out

    def estimates(self, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The unigram counts, their estimates, and for bigrams, then trigrams: bucket of the context (-1: not seen) and estimate."""
        one, two = counts[self.one], counts[self.two]
        context = counts[self.before]
        last = np.zeros(len(one), dtype=counts.dtype)
        last[self.inner] = two[np.flatnonzero(self.inner) - 1]
        three = np.zeros(len(one), dtype=counts.dtype)
        three[self.inner] = counts[self.three]
        return one, one / max(n, 1), [(_bucket(c), x / np.maximum(c, 1)) for c, x in ((context, two), (last, three))]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), -1)


def emit(packed: DataFrame, buckets: int) -> DataFrame:
    """A row for each batch and bucket: the batch's distinct keys there and how often its training texts have them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for rb in frames:
            for batch, part, payload in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                t = _Tokens(payload)
                counts = t.counts(folds(t.ids) != HELD_OUT)
                yield rows_of([(b, batch, part, pack_keys(t.keys[s]), b"", pack_ints(counts[s])) for b, s in by_bucket(t.keys, buckets)])
                del t, counts
                trim()

    return packed.select("batch", "part", "payload").mapInArrow(run, ROWS)


class _Sums(Fold):
    """Totals of the keys; for deleted batches also those without the deleted part."""

    def fold(self, values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(where, weights=values.astype(np.float64), minlength=n).astype(np.uint64)

    def settle(self, values: np.ndarray, part: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        total = self.fold(values, where, n)
        return total, total - self.fold(values * (part == 1), where, n)

    def reply(self, answers: tuple[np.ndarray, ...], part: int) -> bytes:
        total = pack_ints(answers[0])
        return np.array([len(total)], dtype="<i8").tobytes() + total + (pack_ints(answers[1]) if part else b"")

    def read(self, blob: bytes, n: int, part: int) -> tuple[np.ndarray, ...]:
        size = int(np.frombuffer(blob, dtype="<i8", count=1)[0])
        total = unpack_ints(blob[8 : 8 + size])
        return total, unpack_ints(blob[8 + size :]) if part else total

    def stats(self, keys: np.ndarray, answers: tuple[np.ndarray, ...]) -> tuple[int, int]:
        single = ((keys & _U(1)) == 1) & (answers[0] > 0)
        return int(single.sum()), int(answers[0][single].sum())


_SUMS = _Sums()


def _meet(left: pa.Table, right: pa.Table, deleted: bool) -> tuple[_Tokens, np.ndarray]:
    """A batch's tokens and the counts of its keys."""
    fresh()
    t = _Tokens(left["payload"][0].as_py())
    found = sorted(zip(right["bucket"].to_pylist(), right["part"].to_pylist(), right["answer"].to_pylist(), strict=True))
    return t, np.concatenate([_SUMS.read(a, 0, part)[1 if deleted else 0] for _, part, a in found]).astype(np.float64)


class Weights:
    """l1, and l2 and l3 by bucket."""

    def __init__(self, one: float = 0.5, more: np.ndarray | None = None) -> None:
        self.one, self.more = one, np.full((2, BUCKETS), 0.5) if more is None else more

    def mix(self, one: np.ndarray, higher: list[tuple[np.ndarray, np.ndarray]], uniform: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The tokens' probabilities, and the part that each estimate has in it: unigrams, bigrams, trigrams."""
        shares = [self.one * one]
        p = shares[0] + (1 - self.one) * uniform
        for k, (bucket, estimate) in enumerate(higher):
            weight = np.where(bucket >= 0, self.more[k][bucket], 0.0)
            own = weight * estimate
            shares = [s * (1 - weight) for s in shares] + [own]
            p = own + (1 - weight) * p
        return p, shares

    def expect(self, one: np.ndarray, higher: list[tuple[np.ndarray, np.ndarray]], uniform: float) -> np.ndarray:
        """Sums of a round: for each weight what it explains, and what reaches it."""
        p, shares = self.mix(one, higher, uniform)
        out = np.zeros((2, 1 + 2 * BUCKETS))
        left = np.ones(len(p))
        for k in (1, 0):
            bucket, part = higher[k][0], shares[k + 1] / p
            seen = bucket >= 0
            at = slice(1 + k * BUCKETS, 1 + (k + 1) * BUCKETS)
            out[0, at] = np.bincount(bucket[seen], weights=part[seen], minlength=BUCKETS)
            out[1, at] = np.bincount(bucket[seen], weights=left[seen], minlength=BUCKETS)
            left = left - part
        out[:, 0] = (shares[0] / p).sum(), left.sum()
        return out

    def maximise(self, sums: np.ndarray) -> tuple[Weights, float]:
        """The next weights, and the largest change."""
        new = (sums[0] + PRIOR / 2) / (sums[1] + PRIOR)
        old = np.concatenate([[self.one], self.more.reshape(-1)])
        return Weights(float(new[0]), new[1:].reshape(2, BUCKETS)), float(np.abs(new - old).max())


def _fit(observed: DataFrame, uniform: float) -> Weights:
    """Expectation-maximisation over all deleted tokens."""
    weights = Weights()
    for _ in range(ROUNDS):

        def run(frames: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, 1 + 2 * BUCKETS))
            for rb in frames:
                for buckets, estimates in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                    b = np.frombuffer(unsqueeze(buckets), dtype=np.int8).reshape(2, -1).astype(np.int64)
                    e = np.frombuffer(unsqueeze(estimates), dtype="<f4").reshape(3, -1).astype(np.float64)
                    sums += weights.expect(e[0], [(b[0], e[1]), (b[1], e[2])], uniform)
            flat = sums.reshape(-1)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(flat)), pa.int32()), "v": pa.array(flat)})

        rows = observed.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + 2 * BUCKETS)
        sums = np.zeros(2 * (1 + 2 * BUCKETS))
        for r in rows:
            sums[r.k] = r.v
        weights, change = weights.maximise(sums.reshape(2, -1))
        if change < SETTLED:
            break
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    packed = pack(docs, id_col, text_col, _part).drop("extra")
    batches, tasks = tasks_for(packed)
    total = buckets_for(packed)
    at = min(total, FAN)
    answers = exchange(emit(packed, at), at, total, batches, _SUMS, "counts")
    stats = answers.where("batch = -1").agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    v, n = stats.v or 0, stats.n or 0
    uniform = 1 / (v + 1)
    own = answers.where("batch >= 0").select("bucket", "batch", "part", "answer")
    met = lambda df, k: df.repartition(k, "batch").groupBy("batch")

    def observe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"buckets": pa.array([], pa.binary()), "estimates": pa.array([], pa.binary())})
        t, counts = _meet(left, right, True)
        # the deleted tokens are not in the counts, so N is what the others have
        _, one, higher = t.estimates(counts, n_main)
        buckets = np.stack([b for b, _ in higher]).astype(np.int8)
        estimates = np.stack([one, *(e for _, e in higher)]).astype("<f4")
        return pa.table({"buckets": [squeeze(buckets.tobytes())], "estimates": [squeeze(estimates.tobytes())]})

    # the deleted part's own tokens: its documents' words and ends
    deleted, beside = packed.where("part = 1"), own.where("part = 1")
    n_main = n - _size(deleted)
    few = max(8, tasks // FOLDS)
    observed = materialize(met(deleted, few).cogroup(met(beside, few)).applyInArrow(observe, "buckets binary, estimates binary"), "observed")
    weights = _fit(observed, uniform)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        t, counts = _meet(left, right, False)
        one, estimate, higher = t.estimates(counts, n)
        p, _ = weights.mix(estimate, higher, uniform)
        base = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
        ids, begin = t.ids, t.begin
        keys = pa.array(ids, pa.int64(), mask=ids == NO_ID)
        cols = {"doc_id": keys, "held_out": folds(ids) == HELD_OUT, "n_tokens": np.diff(np.append(begin, len(one))), "n_known": np.add.reduceat((one > 0).astype(np.int64), begin), "train_tokens": np.full(len(ids), n, dtype=np.int64), "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(np.log10(p), begin)}
        out = pa.table(cols)
        del t, counts, one, estimate, higher, p, base
        trim()
        return out

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met(packed, tasks).cogroup(met(own, tasks)).applyInArrow(judge, result)


def _size(packed: DataFrame) -> int:
    """Tokens in batches."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            for payload in rb.column(0).to_pylist():
                _, texts = load_batch(payload)
                data, at = join_texts(texts)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(find_words(data, at)[0]) + len(texts)], pa.int64())})

    return packed.select("payload").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
