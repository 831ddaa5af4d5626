"""The opN_ queries: each operator with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import idfile, lm, mainhtml, neardup, packing, pieces, quality, substrings, urls, vectors


#: End ids of the two packed formats.
PACK_END, FILE_END = 0, 2


def tokenizer(name: str) -> str:
    """A public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=PACK_END)


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read(idfile.write(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), FILE_END))


def op4_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(_table(spark, sf_dir, "pages"))


def op5_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classes(_table(spark, sf_dir, "embeddings"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op7_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recompression": op1_recompression,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_tree_scoring": op4_tree_scoring,
    "op5_pigeonhole_join": op5_pigeonhole_join,
    "op6_setsketch": op6_setsketch,
    "op7_lattice_sampling": op7_lattice_sampling,
    "op8_bloom_cascade": op8_bloom_cascade,
    "op9_host_quality": op9_host_quality,
    "op10_id_files": op10_id_files,
}

_W = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op1_recompression": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + {substrings.WINDOW - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS i FROM hit),
tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS k FROM tok t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_pigeonhole_join": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {vectors.COSINE}),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, coalesce(c.m, vec_id) >= vec_id AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_setsketch": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {neardup.THRESHOLD} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, coalesce(c.m, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op8_bloom_cascade": r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op9_host_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_W}')) AS w, generate_subscripts(regexp_extract_all(t, '{_W}'), 1) AS i FROM d),
win AS (SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM win WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM tok GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_W}') GROUP BY doc_id),
f AS (SELECT d.doc_id, source, coalesce(wc.n, 0) AS n_words, coalesce(wc.chars, 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS fails FROM b WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT sum(fails) / sum(docs) AS m, sum(docs) AS n, count(*) - 1 AS free, sum(docs * docs) AS nn FROM h),
w AS (SELECT sum(docs * pow(fails / docs - m, 2)) AS s FROM h, c),
r AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - free > {quality.LEAST_CORRELATION} * n THEN (s / (m * (1 - m)) - free) / (n - nn / n - free) ELSE 0 END AS r FROM c, w),
k AS (SELECT m, 1 / least(greatest(r, {quality.LEAST_CORRELATION}), 1) - 1 AS k FROM r),
bad AS (SELECT source FROM h, k WHERE (fails + m * k) / (docs + k) > {quality.MAX_RATE})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept FROM b""",
}
