"""Quality rules: failures of document rules aggregated by host, rates shrunk with an empirical beta prior.

DataFrame functions only. A document's own rules look at its words (maximal runs of characters other than
\\x20 and \\x09-\\x0D). A host (any column, such as the source) is rejected if the posterior mean of its
failure rate is above max_rate; its prior is fitted to the rates of all hosts by the method of moments, so
hosts with few documents move towards the corpus.

Cases: a null or empty text has no words and fails; a null host has no host verdict, so only the document's
own rules count; repeated rows are judged each by itself and each counts for its host; an empty table gives
an empty result; other columns, whatever their names, are not read by features() and pass through apply().
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.session import materialize, plan_bytes, ship

SPACES = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE, LEAST_CORRELATION = 50, 50, 0.5, 1e-9
#: Rejected hosts up to this many are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 50_000
_F = "__qr_"


def _repeated(words: Column) -> Column:
    """Words in three-word windows that a text has twice or more.

    Windows are sorted by hash, then by their words, then by position; neighbours of equal words are repeats, so no
    count depends on a hash.
    """
    n = F.size(words)
    fields = ("h", "a", "b", "c")

    def window(i: Column) -> Column:
        a, b, c = (F.get(words, i + k) for k in range(3))
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.cast("long").alias("at"))

    def marks(s: Column) -> Column:
        equal = lambda x, y: functools.reduce(lambda p, q: p & q, (x[k] == y[k] for k in fields))
        same = lambda j, x: F.coalesce(equal(F.get(s, j), x), F.lit(False))
        hit = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
        at = F.sort_array(F.transform(hit, lambda x: x["at"]))
        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), n - 3), window)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.transform(F.array(F.sort_array(windows)), marks)[0])


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep's columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(F.col(f"{_F}t"), SPACES), lambda w: w != "")

    def counts(w: Column) -> Column:
        t = F.col(f"{_F}t")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        )

    got = docs.select(*(F.col(k) for k in keep), text.alias(f"{_F}t"))
    got = got.select(*keep, F.explode(F.transform(F.array(words), counts)).alias(f"{_F}c"))
    got = got.select(*keep, f"{_F}c.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host_col: str) -> DataFrame:
    """Rows (host, docs, failures, rate): the posterior mean under a beta prior fitted to all hosts' rates."""
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
    hosts = hosts.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    n, x = F.col("docs").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).cast("double").alias("H"), F.sum(n).alias("N"), F.sum(x).alias("X"), F.sum(n * n).alias("NN"), F.sum(x * x / n).alias("XX"))
    m = F.col("X") / F.col("N")
    spread = (F.col("XX") - F.col("X") * m) / (m * (1 - m)) - (F.col("H") - 1)  # S, by the sums of squares
    room = F.col("N") - F.col("NN") / F.col("N") - (F.col("H") - 1)
    # no failures, or nothing else: m is 0 or 1 and every posterior mean is m
    found = F.when((m > 0) & (m < 1) & (room > LEAST_CORRELATION * F.col("N")), spread / room).otherwise(F.lit(0.0))
    correlation = F.least(F.greatest(found, F.lit(LEAST_CORRELATION)), F.lit(1.0))
    prior = sums.select(m.alias("m"), (1 / correlation - 1).alias("k"))
    rate = (F.col("failures") + F.col("m") * F.col("k")) / (F.col("docs") + F.col("k"))
    # One row against the hosts: the prior is two numbers.
    return hosts.join(F.broadcast(prior)).select("host", "docs", "failures", rate.alias("rate"))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each document: id, the counts, base_failed, host_rejected and kept."""
    ship(docs.sparkSession)
    seen = docs.select(F.col(id_col).alias(id_col), F.col(host_col).cast("string").alias(f"{_F}host"), F.col(text_col).alias(f"{_F}text"))
    judged = materialize(features(seen, f"{_F}text", (id_col, f"{_F}host")), "quality")
    bad = materialize(host_rates(judged, f"{_F}host").where(F.col("rate") > max_rate).select(F.col("host").alias(f"{_F}bad")), "hosts")
    n = bad.count()
    bad = F.broadcast(bad) if n <= BROADCAST_HOSTS and plan_bytes(bad) <= 8 << 20 else bad
    out = judged.join(bad, F.col(f"{_F}host") == F.col(f"{_F}bad"), "left")
    rejected = F.col(f"{_F}bad").isNotNull()
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def apply(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """The documents that pass, with their own columns as they were."""
    ship(docs.sparkSession)
    names = docs.columns
    judged = features(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(f"{_F}row"), F.col(host_col).cast("string").alias(f"{_F}host"), F.col(text_col).alias(f"{_F}text")), f"{_F}text", (f"{_F}row", f"{_F}host"))
    # the rules run once: rows that pass are written, of the others only host and verdict
    row = F.when(~F.col("base_failed"), F.col(f"{_F}row")).alias(f"{_F}row")
    judged = materialize(judged.select(row, f"{_F}host", "base_failed"), "quality")
    bad = materialize(host_rates(judged, f"{_F}host").where(F.col("rate") > max_rate).select(F.col("host").alias(f"{_F}bad")), "hosts")
    n = bad.count()
    small = n <= BROADCAST_HOSTS and plan_bytes(bad) <= 8 << 20
    kept = judged.where(~F.col("base_failed"))
    kept = kept.join(F.broadcast(bad) if small else bad, F.col(f"{_F}host") == F.col(f"{_F}bad"), "left_anti")
    return kept.select(f"{_F}row.*")
