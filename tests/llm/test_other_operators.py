"""Vectors, urls, pages, components, the pipeline."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import links, mainhtml, packing, quality, urls, vectors
from tests.llm import test_text_operators as text_brute
from tests.llm.conftest import DOCS


def cluster_rows(dim, seed):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = r.standard_normal(dim)
            for _ in range(r.integers(1, 9)):
                v = c + r.standard_normal(dim) * r.choice([0.0, 0.1, 0.28, 0.3])
                rows.append((i, [float(x) for x in (v * r.choice([1.0, 3.0])).astype(np.float32)], label))
                i += 1
    rows += [(i, None, 0), (i + 1, [], 0), (i + 2, [0.0] * dim, 0), (i + 3, [math.nan] + [1.0] * (dim - 1), 0), (i + 4, [None] + [1.0] * (dim - 1), 1), (i + 5, [math.inf] * dim, 1), (i + 6, [1.0], 1), (i + 7, [2.0], 1), (i + 8, [1e-30] * dim, 1), (i + 9, [1e30] * dim, 1)]
    return rows


def brute(rows, cosine=0.93):
    ok = [(i, np.array(v, dtype=np.float64), k) for i, v, k in rows if v and k is not None and None not in v]
    ok = [(i, v / np.abs(v).max(), k) for i, v, k in ok if np.isfinite(v).all() and v.any()]
    n, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, x, k), (j, y, m) = ok[a], ok[b]
            if k == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in n}


@pytest.mark.parametrize(("dim", "tile"), [(64, 2048), (64, 5), (16, 3), (5, 2048)])
def test_vectors(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = cluster_rows(dim, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.classes(df).collect()}
    assert got == brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])


def test_vector_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.classes(df).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label long")
    assert sorted(tuple(r) for r in vectors.classes(twice).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    for dim in (1, 3, 64, 100):
        q = vectors.rotation(dim)
        assert np.allclose(q @ q.T, np.eye(dim)) and vectors.edges_of(dim)[-1] == dim


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (3, [1.0, 0.01], 0), (7, [-1.0, 0.0], 0), (7, [0.0, -1.0], 0), (8, [0.0, -1.0], 0), (9, [0.01, 1.0], 0), (9, None, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in vectors.classes(df).collect()), key=str)
    want = [(None, 1, 3, False), (None, 1, 9, False), (3, 1, 3, True), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)


def test_range_joins_measure_few_pairs_and_lose_none():
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 64))
    x[750:] = x[:750] + 0.3 * r.standard_normal((750, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    seen = []
    got = [(a, b) for p, q in vectors.near_pairs(x, len(x), 0.93, seen) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert sorted(got) == list(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 100
    assert len(seen) == 8 and max(seen) < 0.01 * 1500 * 1499 / 2
    cut = [(a, b) for p, q in vectors.near_pairs(x, 700, 0.93) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
    assert sorted(cut) == [(a, b) for a, b in sorted(got) if a < 700 <= b]


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)]
    got = {x.node: x.component for x in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {k: k for e in edges for k in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {k: find(k) for k in root}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["descending", "random"])
def test_components_of_a_long_chain(spark, monkeypatch, order):
    ids = list(range(300))
    random.Random(5).shuffle(ids) if order == "random" else ids.reverse()
    ids.remove(0)
    ids = [0, *ids]  # the least id at one end: it has the whole chain to go
    written = []
    monkeypatch.setattr(links, "materialize", lambda df, tag, write=links.materialize: (written.append(tag), write(df, tag))[1])
    got = links.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert sorted((x.node, x.component) for x in got) == [(k, 0) for k in range(300)]
    assert len(written) < 40


URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y#z", "https://m.example.net/en/1", "https://example.net/en", "https://example.net/EN/1", "https://notexample.com/de/1", "https://x.example.com/de/a", "ftp://org/fr/", "http://a.b.org/fr/x/y", "http://a.b.org?/fr/", "http://xnet/", "x://y://net/", "http://user@h.net:80/p", "http://İ.ORG/fr/é"]


def expected(u):
    host, path = urls.parts(u)
    best = None
    for action, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best and best[1], best[0] if best else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, 5) for i, u in enumerate(URLS * 2)], "page_id long, url string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: expected(u) for i, u in enumerate(URLS * 2)}
    assert urls.parts("HTTP://A.NET/x?y#z") == ("a.net", "/x") and urls.parts("http://a.b.org?/fr/") == ("a.b.org", "")
    assert urls.judge(df.where("page_id < 0")).count() == 0


def test_the_cascade_alone_decides(spark, monkeypatch):
    """With a cascade that lets everything through no url is judged."""
    import pyarrow as pa

    frame = pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["http://a.net/x", "http://b.com/y"]})
    runs = []
    monkeypatch.setattr(urls, "build", lambda *a: [])
    monkeypatch.setattr(urls, "has", lambda levels, keys: np.ones(len(keys), dtype=bool))

    class Pages:
        def select(self, *c):
            return self

        def mapInArrow(self, fn, schema):
            runs.append(fn)

    spark.range(1)
    urls.judge(Pages())
    with pytest.raises(RuntimeError):
        list(runs[0](iter([frame])))


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    monkeypatch.setattr(urls, "PROBES", 1)
    df = spark.createDataFrame([(i, f"http://h{i % 300}.net/p{i % 7}") for i in range(3000)], "page_id long, url string")
    rules = tuple(("block", f"h{i}.net", "/p") for i in range(0, 300, 5))
    levels = urls.build(df, rules)
    assert len(levels) > 2
    universe = sorted({urls.key_hash(h + p) for i in range(3000) for h, p in urls._candidates(*urls.parts(f"http://h{i % 300}.net/p{i % 7}"), [2])})
    listed = {urls.key_hash(h + p) for _, h, p in rules}
    assert urls.has(levels, np.array(universe, dtype=np.uint64)).tolist() == [k in listed for k in universe]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t="</p>";if(a<b){}</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Buy</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, on this fine site.</p></div>
<div id="wrap"><article><h1>Head&nbsp;line</h1><p>First, with <b>bold</b> and a <a href="x">link</a>,
 wrapped.<p>Second &lt;tag&gt; &amp; more, &#233;t&eacute;.<ul><li>One<li>Two</ul><div class="ad">Buy, buy, buy, buy now, all of it, today.</div><table><tr><td>A<td>B</table><form><input value="x">Sign up, please</form>
<aside>Related things, many of them</aside><p>Last<br>line</p></article><section class="comments"><p>First comment, rather long, with commas, and more commas, so many.</p></section></div>
<div class="sidebar"><p>Side text, which is long, and has commas, and goes on, and on, and on.</p></div><footer>&copy; me, here, now</footer></body></html>"""


def test_main_text():
    assert mainhtml.extract(PAGE) == "Head line\nFirst, with bold and a link, wrapped.\nSecond <tag> & more, été.\nOne\nTwo\nA\nB\nLast line"
    plain = "<body><div id=menu><a href=a>A</a></div><div class=content><p>" + "Words, more words, and yet more words here. " * 5 + "</p><p>Short.</p></div><div class='comments'><p>" + "Blah, blah, blah, blah. " * 9 + "</p></div></body>"
    assert mainhtml.extract(plain) == ("Words, more words, and yet more words here. " * 5).strip() + "\nShort."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p>", "<!--", "<article>", "<script>x", "<nav><a href=x>y</a></nav>", "<a" * 2000, "<p " + "a='" * 500, "\x00", "<div>" * 3000])
def test_pages_without_text(page):
    assert isinstance(mainhtml.extract(page), str)


def sentence(r, n):
    return " ".join(r.choice(["sea", "wind,", "stone", "river,", "field", "night"]) for _ in range(n)) + "."


def made_page(r):
    """A page around a known text, and that text."""
    text = [("h1", sentence(r, 4))] + [("p", sentence(r, r.randint(12, 70))) for _ in range(r.randint(3, 9))]
    if r.random() < 0.5:
        text.insert(r.randint(2, len(text)), ("h2", sentence(r, 3)))
    if r.random() < 0.4:
        text.insert(r.randint(2, len(text)), ("li", sentence(r, 9)))
    noise = [
        lambda: "<div class='%s'><p>%s</p></div>" % (r.choice(["ad", "promo box", "sidebar", "cookie-notice", "related"]), sentence(r, r.randint(5, 25))),
        lambda: "<ul>" + "".join(f"<li><a href='/x'>{sentence(r, 6)}</a></li>" for _ in range(r.randint(3, 12))) + "</ul>",
        lambda: "<aside><p>" + sentence(r, 30) + "</p></aside>",
        lambda: "<form><p>Name, mail, and more</p><input></form><script>var a = '</p>';</script><!-- <p>no</p> -->",
    ]
    inner = ""
    for tag, words in text:
        if r.random() < 0.25 and tag == "p" and inner.count("<p>") > 1:
            inner += r.choice(noise)()
        k = words.find(" ", len(words) // 2)
        marked = words[:k] + r.choice([" <b>", " <a href=y>", "\n <i>"]) + words[k + 1 :] + "</b></a></i>" if k > 0 and r.random() < 0.3 else words
        inner += f"<ul><li>{marked}</ul>" if tag == "li" else f"<{tag}>{marked}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag}>")
    kind = r.choice(["article", "div", "div class='post related-post'", "main", "section"])
    body = f"<{kind}>{inner}</{kind.split()[0]}>"
    for _ in range(r.randint(0, 2)):
        body = f"<div id=w{r.randint(1, 9)}>{body}</div>"
    comments = "<section class=comments>" + "".join(f"<p>{sentence(r, r.randint(3, 20))}</p>" for _ in range(r.randint(0, 4))) + "</section>"
    nav = "<nav><ul>" + "".join(f"<li><a href=/>{sentence(r, 1)}</a></li>" for _ in range(6)) + "</ul></nav>"
    return f"<html><head><title>T, t</title></head><body><header><h2>Site</h2></header>{nav}{r.choice(noise)()}{body}{comments}<footer><p>{sentence(r, 20)}</p></footer></body></html>", "\n".join(w for _, w in text)


@pytest.mark.parametrize("seed", range(200))
def test_made_pages(seed):
    page, text = made_page(random.Random(seed))
    assert mainhtml.extract(page) == text


def test_scores_and_not_names_decide():
    story = "A sentence, with words, and more. " * 20
    assert mainhtml.extract(f"<body><nav><a href=x>x</a></nav><div class='post related-post'><p>{story}</p></div></body>") == story.strip()
    links = "".join(f"<li><a href=x>Linked headline number {i}, with a comma</a></li>" for i in range(12))
    assert mainhtml.extract(f"<article><h1>T</h1><p>{story}</p><ul>{links}</ul><p>end.</p></article>") == f"T\n{story.strip()}\nend."
    parts = "".join(f"<section><h2>S{i}</h2><p>{story}</p></section>" for i in range(4))
    assert mainhtml.extract(f"<body><div><h1>T</h1>{parts}</div></body>").count("\n") == 8


@pytest.mark.parametrize("page", ["<a" * 500_000, "<div>" * 20_000, "<div>x, and more text " * 20_000, '<p "' * 100_000, "<p a='>x" * 50_000, "<b>" * 10_000 + "<div></div>" * 10_000, "<div>" * 20_000 + "</section>" * 20_000, "<!--" * 100_000, "<" * 300_000], ids=range(9))
def test_time_in_proportion_to_length(page):
    begin = time.process_time()
    mainhtml.extract(page)
    assert time.process_time() - begin < 2


def test_cut_pages():
    for k in range(len(PAGE)):
        mainhtml.extract(PAGE[:k])
    assert mainhtml.extract("<article><h1>A</h1><p>text &am") == "A\ntext &am" and mainhtml.extract("<article><p>text</p><di") == "text"
    assert mainhtml.extract("plain words") == "plain words"


def test_main_text_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    rows = sorted((tuple(r) for r in mainhtml.main_text(df).collect()), key=str)
    assert rows[0] == (1, "u", mainhtml.extract(PAGE), len(mainhtml.extract(PAGE))) and rows[2] == (2, None, "", 0)
    assert mainhtml.main_text(df.where("page_id > 9")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")  # written before the next stage, as run() does
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == columns and after.count() <= frame.count(), name
        frame = after
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in frame.collect()} and 0 < len({r.doc_id for r in out}) < len(DOCS)
    assert 200 in {r.doc_id for r in out} and 201 not in {r.doc_id for r in out}


def fails(t):
    w = (t or "").encode().split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    return len(w) < quality.MIN_WORDS or 100 * len(hit) > quality.MAX_REPEAT_PERCENT * len(w)


def rejected_hosts(rows):
    hosts = defaultdict(list)
    for _, t, host in rows:
        if host is not None:
            hosts[host].append(fails(t))
    n, x = [len(v) for v in hosts.values()], [sum(v) for v in hosts.values()]
    m = sum(x) / sum(n)
    free, room = len(n) - 1, sum(n) - sum(k * k for k in n) / sum(n) - (len(n) - 1)
    spread = sum(k * (y / k - m) ** 2 for k, y in zip(n, x, strict=True))
    r = min(max((spread / (m * (1 - m)) - free) / room, quality.LEAST_CORRELATION), 1) if 0 < m < 1 and room > 0 else quality.LEAST_CORRELATION
    k = 1 / r - 1
    return {h for h, v in hosts.items() if (sum(v) + m * k) / (len(v) + k) > quality.MAX_RATE}


def test_every_stage_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocab = [f"v{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randint(60, 150)) + " " + (passage if i % 9 == 0 else ""), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, text(20) if i % 6 else text(80), "farm") for i in range(30)]
    near = text(120)
    rows += [(200 + i, near + (" x" * i), "s1") for i in range(4)] + [(210, rows[5][1], "s2"), (211, None, "s0"), (212, "", None), (213, "again and again " * 40, "s3"), (214, text(70), None)]
    spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bad = rejected_hosts(rows)
    assert bad == {"farm"}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, t) for i, t, h in rows if not fails(t) and h not in bad)
    for (name, stage), step in zip(corpus_pipeline.STAGES, (None, near_step, passage_step, None), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "best_fit_packing":
            break
        want = step(want) if step else want
        got = sorted((x.doc_id, x.text) for x in docs.collect())
        assert got == want and 0 < len(got) < len(rows), name
        assert all(x.n_chars == len(x.text) for x in docs.collect())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want}
    out = docs.collect()
    assert {x.doc_id: x.length for x in out} == sizes  # no text is as long as a sequence
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values()) and len(bins) <= packing.best_fit(np.array(list(sizes.values())), 2048)[2]
    assert sorted((x.doc_id, x.length) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(sizes.items())


def near_step(rows):
    return sorted((i, t) for (i, t), (j, _, c) in zip(sorted(rows, key=lambda x: str(x[0])), text_brute.components(5, sorted(rows, key=lambda x: str(x[0]))), strict=True) if i == j == c)


def passage_step(rows):
    gone = {i: (n, kept) for i, _, n, kept in text_brute.removed(13, rows)}
    return sorted((i, gone[i][1] if gone[i][0] else t) for i, t in rows)


def test_stages_shrink_the_heaps_first(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.quality_rules(spark, docs, "")
    assert full() > before
