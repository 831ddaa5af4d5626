"""Operators on documents against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import batches, lm, neardup, quality, substrings, words
from tests.llm.conftest import CLASHES, DOCS

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BIG = 1 << 62


def split(t):
    return (t or "").encode().split()


def test_words_and_hashes_follow_bytes_split():
    texts = [None if t is None else t.encode() for _, t in DOCS]
    data, at = words.join_texts(texts)
    starts, ends, first = words.find_words(data, at)
    raw = data.tobytes()
    got = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in (t or b"").split()]
    assert np.diff(first).tolist() == [len((t or b"").split()) for t in texts]
    h = words.hash_words(data, starts, ends).tolist()
    assert len(set(h)) == len(set(got)) and len({(a, b) for a, b in zip(h, got, strict=True)}) == len(set(got))


def test_packed_ints_and_batches_round_trip():
    for v in ([], [0, 0], [1, 255, 256, 2**63], [2**64 - 1]):
        assert batches.unpack_ints(batches.pack_ints(np.array(v, dtype=np.uint64))).tolist() == v
    ids, texts = [1, None, 3], [b"a", None, b""]
    got = batches.load_batch(batches.dump_batch(ids, texts))
    assert got[0].tolist() == [1, batches.NO_ID, 3] and got[1] == texts


# substrings


def removed(window, docs=DOCS):
    first = {}
    order = sorted(range(len(docs)), key=lambda k: BIG if docs[k][0] is None else docs[k][0])
    for k in order:
        i = BIG if docs[k][0] is None else docs[k][0]
        w = split(docs[k][1])
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = []
    for i, t in docs:
        w, key = split(t), BIG if i is None else i
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < key:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 4, 13, 50])
def test_substrings(docs, window):
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs, window=window).collect()]
    assert sorted(got, key=str) == removed(window)


@pytest.mark.parametrize(("least", "fan"), [(4, 4), (16, 4), (64, 4), (8, 2)])
def test_substrings_whatever_the_exchange(docs, monkeypatch, least, fan):
    """Key spaces of one, two and three steps."""
    monkeypatch.setattr(batches, "BATCH_DOCS", 9)
    monkeypatch.setattr(batches, "FAN", fan)
    monkeypatch.setattr(substrings, "FAN", fan)
    monkeypatch.setattr(substrings, "buckets_for", lambda packed: least)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs, window=4).collect()]
    assert sorted(got, key=str) == removed(4)


def test_a_batch_sends_to_fan_buckets_whatever_their_number(spark, docs, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_DOCS", 5)
    monkeypatch.setattr(batches, "FAN", 4)
    packed = batches.pack(docs)
    n = packed.count()

    class Least(batches.Fold):
        def fold(self, values, where, k):
            out = np.full(k, np.uint64(2**63))
            np.minimum.at(out, where, values)
            return out

    def emit(frames):
        for rb in frames:
            for b in rb.column(0).to_pylist():
                keys = np.sort(words.mix(np.arange(b % 97, b % 97 + 500).astype(np.uint64)))
                yield batches.rows_of([(k, b, 0, batches.pack_keys(keys[s]), b"", batches.pack_ints(np.full(s.stop - s.start, b % 89, np.uint64))) for k, s in batches.by_bucket(keys, 4)])

    rows, write = [], batches.materialize
    monkeypatch.setattr(batches, "materialize", lambda df, tag: (lambda out: (rows.append((tag, out.count())), out)[1])(write(df, tag)))
    for buckets in (16, 64):
        rows.clear()
        got = batches.exchange(packed.mapInArrow(emit, batches.ROWS), 4, buckets, n, Least(), "t")
        ids = [r.batch for r in packed.collect()]
        want = {b: [min(c % 89 for c in ids if c % 97 <= k < c % 97 + 500) for k in range(b % 97, b % 97 + 500)] for b in ids}
        for b in ids:
            found = sorted((r.bucket, r.answer) for r in got.where(f"batch = {b}").collect())
            values = np.concatenate([batches.unpack_ints(a) for _, a in found])
            order = np.argsort(words.mix(np.arange(b % 97, b % 97 + 500).astype(np.uint64)))
            assert values.tolist() == [want[b][k] for k in order]
        assert max(c for t, c in rows) <= 4 * n + 64 + 16 * (n + 8) and dict(rows)["tup"] == 4 * n


def test_keys_round_trip_and_pairs():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        k = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (batches.unpack_keys(batches.pack_keys(k)) == k).all()
        for b in (1, 2, 64, 1 << 20):
            assert [x for _, s in batches.by_bucket(k, b) for x in k[s].tolist()] == k.tolist()
    key, check = np.array([5, 1, 5, 5, 1], np.uint64), np.array([2, 7, 1, 2, 7], np.uint64)
    a, b, where = batches.distinct_pairs(key, check)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 7), (5, 1), (5, 2)] and where.tolist() == [2, 0, 1, 2, 0]


def test_substring_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(1)
    for alphabet in (2, 5, 1000):
        core = words.mix(r.integers(0, alphabet, 13).astype(np.uint64))
        seen = set()
        for _ in range(20):
            left, right = (words.mix(r.integers(0, alphabet, 9).astype(np.uint64)) for _ in range(2))
            doc = np.concatenate([left, core, right])
            seen.add(int(substrings.anchors(doc, np.array([0, len(doc)]), np.array([9]), 13)[0]))
        assert len(seen) == 1


def test_substring_stage_keeps_columns(docs, empty):
    got = substrings.apply(docs)
    assert got.columns == docs.columns and got.count() == len(DOCS)
    changed = {(r[0], r[2]) for r in removed(13) if r[2]}
    before = defaultdict(set)
    for i, t in DOCS:
        before[i].add(t)
    for r in got.collect():
        if (r.doc_id, 0) in {(d, 0) for d, _ in changed}:
            assert r.text not in before[r.doc_id]
        else:
            assert r.text in before[r.doc_id]
        assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))
    assert substrings.dedup(empty).count() == 0 and substrings.apply(empty).count() == 0


# near-duplicates


def shingles(t, n):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components(n, docs=DOCS):
    ids = [BIG if i is None else i for i, _ in docs]
    sets = [shingles(t, n) for _, t in docs]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(BIG if i is None else i)) for (i, _), s in zip(docs, sets, strict=True)), key=str)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_near_duplicates(docs, n):
    got = neardup.classes(docs, shingle=n).collect()
    assert sorted(((r.doc_id, r.n_shingles, BIG if r.component_id is None else r.component_id) for r in got), key=str) == components(n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_families_where_the_least_is_not_the_centre(spark):
    """Copies of a centre, each with own edits: many link to the centre only."""
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    rows = []
    for family in range(4):
        centre = [r.choice(vocab) for _ in range(200)]
        for k in range(60):
            copy = centre[:]
            for _ in range(0 if k == 59 else r.randint(6, 12)):
                copy[r.randrange(200)] = r.choice(vocab)
            rows.append((family * 1000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: shingles(t, 2) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in neardup.classes(df).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(got)


def test_estimates_are_near_the_similarity():
    r = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        pool = words.mix(r.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        regs = neardup.registers([a, b])
        got = neardup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 0.15
    union = neardup.registers([np.union1d(a, b)])[0]
    assert (union == np.maximum(regs[0], regs[1])).all()  # sketches merge


def test_miss_rates_at_the_threshold():
    """The estimate's cut before the exact sets must lose far less than the bands do, whose rate the docstring states."""
    bands = (1 - 0.8**neardup.ROWS) ** neardup.BANDS
    tail = sum(math.comb(neardup.M, k) * 0.8**k * 0.2 ** (neardup.M - k) for k in range(neardup.M + 1) if k < neardup.CUT * neardup.M)
    assert tail < bands / 1000 and f"{bands:.1e}".replace("e-0", "e-") in neardup.__doc__


def test_near_duplicate_stage(docs, empty):
    kept = neardup.apply(docs, shingle=2)
    assert kept.columns == docs.columns
    want = Counter(str(i) for i, _, c in components(2) if (BIG if i is None else i) == c)
    assert Counter(str(r.doc_id) for r in kept.collect()) == want
    assert neardup.classes(empty).count() == 0 and neardup.apply(empty).count() == 0


# language model


def test_language_model(docs, empty):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    tokens = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t in DOCS]
    train = Counter(w for i, ws in tokens if fold(i) for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), fold(i) == 0, len(ws), sum(train[w] > 0 for w in ws), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    rows = lm.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    scores = brute_scores(tokens, fold)
    brute = sorted((str(i), x) for (i, _), x in zip(tokens, scores, strict=True))
    assert all(a == b and math.isclose(x, y, rel_tol=1e-6) for (a, x), (b, y) in zip(sorted((str(r.doc_id), r.score) for r in rows), brute, strict=True))
    assert lm.score(empty).count() == 0


def ngrams(tokens):
    count = Counter()
    for ws in tokens:
        count["start"] += 1
        for k, w in enumerate(ws):
            count[1, w] += 1
            count[2, ws[k - 1] if k else "start", w] += 1
            if k:
                count[3, ws[k - 2] if k > 1 else "start", ws[k - 1], w] += 1
    return count


def estimates(ws, count, n):
    """For each token: unigram estimate, then (context's count, estimate) of bigram and trigram."""
    for k, w in enumerate(ws):
        u = count[1, ws[k - 1]] if k else count["start"]
        uv = count[2, ws[k - 2] if k > 1 else "start", ws[k - 1]] if k else 0
        three = count[3, ws[k - 2] if k > 1 else "start", ws[k - 1], w] if k else 0
        yield count[1, w] / n, (u, count[2, ws[k - 1] if k else "start", w] / max(u, 1)), (uv, three / max(uv, 1))


def bucket(c):
    return min(int(math.log2(c)), 15)


def mixture(l1, l2, l3, p1, two, three, uniform):
    a, b = (l2[bucket(two[0])] if two[0] else 0.0), (l3[bucket(three[0])] if three[0] else 0.0)
    parts = [(1 - b) * (1 - a) * l1 * p1, (1 - b) * a * two[1], b * three[1]]
    return sum(parts) + (1 - b) * (1 - a) * (1 - l1) * uniform, parts


def brute_scores(tokens, fold):
    whole = ngrams([ws for i, ws in tokens if fold(i)])
    main = ngrams([ws for i, ws in tokens if fold(i) not in (0, 9)])
    size = lambda keep: sum(len(ws) for i, ws in tokens if keep(fold(i)))
    uniform = 1 / (sum(1 for k in whole if k[0] == 1) + 1)
    seen = [e for i, ws in tokens if fold(i) == 9 for e in estimates(ws, main, size(lambda f: f not in (0, 9)))]
    l1, l2, l3 = 0.5, [0.5] * 16, [0.5] * 16
    for _ in range(lm.ROUNDS):
        hit, all_ = Counter(), Counter()
        for p1, two, three in seen:
            p, parts = mixture(l1, l2, l3, p1, two, three, uniform)
            left = 1.0
            if three[0]:
                hit[3, bucket(three[0])] += parts[2] / p
                all_[3, bucket(three[0])] += left
            left -= parts[2] / p
            if two[0]:
                hit[2, bucket(two[0])] += parts[1] / p
                all_[2, bucket(two[0])] += left
            left -= parts[1] / p
            hit[1] += parts[0] / p
            all_[1] += left
        old = [l1, *l2, *l3]
        l1 = (hit[1] + 0.5) / (all_[1] + 1)
        l2, l3 = ([(hit[k, b] + 0.5) / (all_[k, b] + 1) for b in range(16)] for k in (2, 3))
        if max(abs(x - y) for x, y in zip(old, [l1, *l2, *l3], strict=True)) < lm.SETTLED:
            break
    n = size(lambda f: f)
    return [sum(math.log10(mixture(l1, l2, l3, *e, uniform)[0]) for e in estimates(ws, whole, n)) for _, ws in tokens]


def test_mixtures_sum_to_one():
    """Over all words and the unseen one, for contexts that are seen, seen once and not seen."""
    r = random.Random(1)
    tokens = [[r.choice("abcd") for _ in range(9)] + [None] for _ in range(20)]
    count = ngrams(tokens)
    words_ = ["a", "b", "c", "d", None]
    weights = lm.Weights(0.7, np.random.default_rng(0).random((2, 16)))
    n = sum(len(t) for t in tokens)
    for history in (["a", "b"], ["d", "d"], ["x", "a"], ["x", "y"]):
        rows = [list(estimates([*history, w], count, n))[-1] for w in words_]
        one = np.array([e[0] for e in rows] + [0.0])
        higher = [tuple(np.array([e[k][j] for e in rows] + [rows[0][k][0] if j == 0 else 0.0]) for j in (0, 1)) for k in (1, 2)]
        p, _ = weights.mix(one, [(lm._bucket(c), e) for c, e in higher], 1 / 6)
        assert abs(p.sum() - 1) < 1e-9


@pytest.mark.parametrize(("least", "fan"), [(4, 4), (64, 4)])
def test_language_model_whatever_the_exchange(docs, monkeypatch, least, fan):
    want = sorted((str(r.doc_id), round(r.score, 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(batches, "BATCH_DOCS", 9)
    monkeypatch.setattr(batches, "FAN", fan)
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "buckets_for", lambda packed: least)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in lm.score(docs).collect()) == want


def test_weights_follow_the_held_out_counts():
    """Contexts of bucket 3 foretell the token, those of bucket 0 don't."""
    one, two = np.full(1000, 0.01), np.where(np.arange(1000) < 500, 0.9, 0.0)
    bucket_ = np.where(np.arange(1000) < 500, 3, 0)
    weights = lm.Weights()
    for _ in range(lm.ROUNDS):
        weights, change = weights.maximise(weights.expect(one, [(bucket_, two), (np.full(1000, -1), two * 0)], 1e-4))
    assert weights.more[0][3] > 0.95 and weights.more[0][0] < 0.01 and change < 0.01
    assert weights.one > 0.9 and weights.more[1].tolist() == [0.5] * 16  # nothing seen


def test_known_continuations_score_higher(spark):
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(i, "a b a c b a " * (i % 4 + 1)) for i in range(40)] + list(zip(held, ["a b a", "b b b", "zzz zzz zzz", ""], strict=True))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    scores = [got[i].score for i in held]
    assert scores[0] > max(scores[1:3]) and [got[i].n_known for i in held] == [4, 4, 1, 1]


# quality


def test_quality(docs, empty, spark):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()), key=str)
    want = []
    for i, t in DOCS:
        w, t = split(t), t or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want, key=str)
    assert quality.judge(empty).count() == 0 and quality.apply(empty).count() == 0
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString() + quality.features(docs, "text", ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats_are_told_apart_by_words(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *cols: F.lit(5).cast("long"))  # every hash collides
    docs = spark.createDataFrame([("a b c d e f g",), ("a b c x a b c y",)], "text string")
    assert [r.n_repeat_words for r in quality.features(docs).collect()] == [0, 6]


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, good if i % 50 else bad, f"good{i % 8}") for i in range(800)] + [(1000 + i, bad if i % 20 else good, "farm") for i in range(200)] + [(2000, bad, "tiny"), (2001, good, "one"), (2002, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[1000 + 20].base_failed is False and got[1020].kept is False and got[1020].host_rejected  # a good page of a bad host
    assert got[1].kept and got[2001].kept and got[2002].kept and not got[2000].kept
    kept = {r.doc_id for r in quality.apply(df).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and quality.apply(df).columns == df.columns


def rates(spark, sizes, chance, seed):
    r = np.random.default_rng(seed)
    rows = [(f"h{k}", bool(f)) for k, (n, c) in enumerate(zip(sizes, chance, strict=True)) for f in r.random(n) < c]
    got = quality.host_rates(spark.createDataFrame(rows, "source string, base_failed boolean"), "source").collect()
    return {x.host: x for x in got}, sum(f for _, f in rows) / len(rows)


def test_hosts_that_differ_by_chance_have_the_corpus_rate(spark):
    for sizes in ([1] * 3000, [5] * 800, [3] * 400 + [40] * 50):
        got, mean = rates(spark, sizes, [0.3] * len(sizes), 1)
        assert max(abs(x.rate - mean) for x in got.values()) < 0.06


def test_the_prior_has_the_strength_of_the_hosts_spread(spark):
    """Failure rates drawn from beta(2, 3): a prior of five documents, and so the posterior mean of each host."""
    sizes = [4] * 1500 + [30] * 300
    chance = np.random.default_rng(3).beta(2, 3, len(sizes))
    got, mean = rates(spark, sizes, chance, 2)
    for x in got.values():
        assert abs(x.rate - (x.failures + 5 * mean) / (x.docs + 5)) < 0.07
    apart, mean = rates(spark, [50] * 40, [0.0, 1.0] * 20, 3)  # nothing to shrink
    assert {round(x.rate, 6) for x in apart.values()} == {0.0, 1.0}
    same, _ = rates(spark, [7] * 5, [1.0] * 5, 4)
    assert {x.rate for x in same.values()} == {1.0}


def test_sha_of_kept_words_is_that_of_the_text(docs):
    row = substrings.dedup(docs).where("doc_id = 200").select("text", F.sha2("text", 256).alias("s")).first()
    assert row.s == hashlib.sha256(row.text.encode()).hexdigest()
