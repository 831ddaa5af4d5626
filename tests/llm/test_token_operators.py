"""Tokenizer-based operators: exact ids, packing bounds, files, sampled pieces."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from terrafold.llm import idfile, packing, pieces  # noqa: E402
from terrafold.llm.tokens import Encoder  # noqa: E402
from tests.llm.conftest import DOCS  # noqa: E402

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def direct(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)  # nothing else is set
    return [e.ids for e in t.encode_batch([x or "" for _, x in DOCS], add_special_tokens=False)]


MARKED = ["<|endoftext|>", "a <|endoftext|> b", "word<|endoftext|>word", " <|endoftext|>", "<|endoftext|> \n", "<|endoftext|><|endoftext|>x", "<|startoftext|> a b<|startoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext", "a\u00a0<|endoftext|>\u3000b  c", "it's<|endoftext|>'s <|startoftext|>  2", "a" * 3000 + "<|endoftext|>" + " b" * 3000]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_strings_of_added_tokens(path, drops):
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(MARKED, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(path, drops).encode([t.encode() for t in MARKED])] == want
    assert any(i >= 49406 for ids in want for i in ids)


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
@pytest.mark.parametrize("cache", [1_500_000, 300])
def test_cached_units_give_the_library_s_ids(monkeypatch, path, drops, cache):
    from terrafold.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_UNITS", cache)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    e = Encoder(path, drops)
    for _ in range(2):
        got = [x.tolist() for x in e.encode([None if t is None else t.encode() for _, t in DOCS])]
        assert got == direct(path)


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_cached_units_are_bounded_in_bytes(monkeypatch, path, drops):
    from random import Random

    from terrafold.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 20_000)
    r = Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300))
    texts = ["common words " + " ".join(word() for _ in range(60)) for _ in range(100)]
    e = Encoder(path, drops)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in e.encode([t.encode() for t in texts])] == want
        assert sum(x.nbytes for x in (e.key, e.check, e.size, e.start, e.ids, e.used)) < 5 << 18


def test_packing(docs, empty):
    rows = packing.pack(docs, WORD, length=256).collect()
    want = Counter()
    for (i, _), ids in zip(DOCS, direct(WORD), strict=True):
        ids = np.array([*ids, 0], dtype="<u4")
        for k in range(0, len(ids), 256):
            want[i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 256
    assert len(bins) <= 1.02 * packing.lower_bound(np.bincount([r.length for r in rows], minlength=257), 256) + 1
    assert packing.pack(empty, WORD).count() == 0


def test_exchange_between_partitions_only_helps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_PARTITION", 150)
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 900).tolist()
    cut = spark.createDataFrame([(i, 0, 0, s, 0, i + 1) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    rows = packing.assign(cut, 100).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 900 and max(fill.values()) <= 100
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    assert bound <= len(fill) <= packing.best_fit(np.array(sizes), 100)[2] * 1.03


def test_groups_of_bounded_size_go_on_exchanging(spark, monkeypatch):
    """Groups can't merge into one; rounds still save bins, every piece keeps a place, and the verdict is the truth."""
    monkeypatch.setattr(packing, "PER_PARTITION", 30)
    monkeypatch.setattr(packing, "MOST", 60)
    rng = np.random.default_rng(5)
    sizes = rng.integers(20, 70, 900).tolist()
    cut = spark.createDataFrame([(i, 0, 0, s, 0, i + 1) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    rows = packing.assign(cut, 100).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 900 and all(sum(n for _, n in b) <= 100 for b in bins.values())
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
    bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
    alone = sum(packing.best_fit(np.array(sizes[k : k + 30]), 100)[2] for k in range(0, 900, 30))
    assert bound <= len(bins) < alone and {r.certified for r in rows} == {len(bins) <= bound}


@pytest.mark.parametrize("seed", range(6))
def test_lower_bound_is_a_bound(seed):
    """Bins that are full by construction: no bound may exceed their number; best fit may not fall below the bound."""
    rng = np.random.default_rng(seed)
    sizes, n = [], 30
    for _ in range(n):
        left = 60
        while left:
            s = int(rng.integers(1, left + 1))
            sizes.append(s)
            left -= s
    counts = np.bincount(sizes, minlength=61)
    assert packing.lower_bound(counts, 60) <= n
    bins, at, used = packing.best_fit(np.array(sizes), 60)
    assert used >= packing.lower_bound(counts, 60) and np.bincount(bins, weights=sizes).max() <= 60


def test_lower_bound_sees_large_pieces():
    assert packing.lower_bound(np.bincount([60] * 5, minlength=101), 100) == 5
    assert packing.lower_bound(np.bincount([34] * 6, minlength=101), 100) == 3


@pytest.mark.parametrize("block", [4 << 20, 100])
def test_id_files(docs, empty, monkeypatch, block):
    monkeypatch.setattr(idfile, "BLOCK_BYTES", block)
    manifest = idfile.write(docs, BYTE, 2)
    rows = sorted(idfile.read(manifest).collect(), key=lambda r: r.start)
    want = Counter()
    for (i, _), ids in zip(DOCS, direct(BYTE), strict=True):
        want[i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(i for i, _ in DOCS if i is not None) and rows[-1].doc_id is None
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    none = idfile.write(empty, BYTE, 2)
    assert none.count() == 0 and idfile.read(none).count() == 0


def test_keyed_access_reads_little(docs, monkeypatch, tmp_path):
    manifest = idfile.write(docs, BYTE, 2)
    ids = dict(reversed(list(zip([i for i, _ in DOCS], direct(BYTE), strict=True))))
    for key in (0, 309, 308, 301, None):
        assert idfile.get(manifest, key).tolist() == [*ids[key], 2]
    assert idfile.get(manifest, 10**6) is None and idfile.get(manifest, -1) is None
    row = manifest.where("first <= 309 AND last >= 309").first()
    shard, read = idfile.Shard(row.file), []
    real = shard.file

    class Counted:
        def read_at(self, n, at):
            read.append(n)
            return real.read_at(n, at)

    shard.file = Counted()
    assert shard.get(309).tolist() == [*ids[309], 2]
    assert sum(read) - 2 * (len(ids[309]) + 1) + 64 < 200  # displacement, slot, offsets and the footer, besides the ids
    assert all(shard.rank(k) == -1 for k in range(10**6, 10**6 + 500))
    keys = shard.words("keys", 0, shard.docs) if (setattr(shard, "file", real) is None) else None
    assert [shard.rank(k) for k in keys.tolist()] == shard.ranks_of(keys).tolist()
    bad = tmp_path / "bad.ids"
    bad.write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        idfile.Shard(f"file://{bad}")


def test_units_begin_where_no_piece_goes_on():
    space = pieces.unit_space([b" a", b";\r", b"\r\t"])
    assert not space[[13, 9]].any() and space[[32, 10, 11, 12]].all()
    with pytest.raises(ValueError):
        pieces.unit_space([b"a\n"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 5 * 10**11
    assert sorted(idfile.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))


def test_pieces(docs, empty):
    coded = pieces.encode(docs, PIECE)
    rows = coded.collect()
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, PIECE).collect()) == sorted((str(i), t or "") for i, t in DOCS)
    again = {str(r.doc_id): r.ids for r in pieces.encode(docs.repartition(2), PIECE).collect()}
    assert all(again[str(r.doc_id)] == r.ids for r in rows)  # whatever the partitions
    digest = {str(r.doc_id): r for r in pieces.digest(docs, PIECE).collect()}
    assert all(digest[str(r.doc_id)].lossless and digest[str(r.doc_id)].ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    assert pieces.encode(empty, PIECE).count() == 0 and pieces.digest(empty, PIECE).count() == 0


@pytest.mark.parametrize(("text", "alpha"), [(b" hello", 1e-3), (b" x);\r\n", 5e-5)])
def test_pieces_are_sampled_by_their_weights(text, alpha):
    """The second has pieces that end in a carriage return."""
    import math

    import sentencepiece

    m = pieces.PieceModel(PIECE)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = {s: i for i, s in enumerate(m.surface) if s and not sp.is_byte(i)}
    n = 20_000

    def ways(k):
        if k == len(text):
            yield ()
        for e in range(k + 1, len(text) + 1):
            i = own.get(text[k:e], int(m.byte_ids[text[k]]) if e - k == 1 else None)
            if i is not None:
                for rest in ways(e):
                    yield (i, *rest)

    score = lambda i: m.byte_score if sp.is_byte(i) else sp.get_score(i)
    weight = {w: alpha * sum(map(score, w)) for w in ways(0)}
    top = max(weight.values())
    weight = {w: math.exp(x - top) for w, x in weight.items()}
    total = sum(weight.values())
    got = Counter(tuple(x.tolist()) for x in m.sample([text[1:]] * n, np.arange(n), alpha))
    assert set(got) <= set(weight) and len(weight) > 3
    assert max(abs(got[w] / n - weight[w] / total) for w in weight) < 0.015
    other = Counter(tuple(x.tolist()) for x in m.sample([text[1:]] * n, np.arange(n), alpha, seed=9))
    assert other != got
