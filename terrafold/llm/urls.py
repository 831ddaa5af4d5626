"""URL filters by a Bloom filter cascade.

Rules are keys: a host, then a path prefix. A url's possible keys are its host's suffixes at label borders,
each with the prefixes of its path that have a rule path's length. The cascade's first level holds the listed
keys; the second holds what the first lets through of all other keys of the corpus; the third what the second
lets through of the listed keys, and so on until a level lets nothing wrong through. Since the levels were
checked against the corpus's complete key universe, membership is exact for every key of it, and a look-up
needs no join. The level that refuses a key decides: refused by an odd level, it is not listed; by an even one, it is.
The rule's text and action are then read by the listed key's hash.

The first level is sized to the list and to the number of keys in the corpus, so what is collected for the
next one stays near the list's size; its count is checked and the level enlarged if need be.

Cases: a null url, or one without ://, has an empty host and path; equally long rules that fit: the longer
host wins, and of equal ones the first listed; repeated rows are judged each by itself; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.words import mix
from terrafold.session import materialize, ship

#: (action, host, path): fixed values of the production list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
PROBES, LEAST_BITS, MOST_WRONG = 4, 1 << 10, 1_000_000
_PARTS = re.compile(r"[^/?#]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = _PARTS.match(rest)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.partition(mark)[0]
    return host.translate(_LOWER), path


def key_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))


class Level:
    """A Bloom filter over 64-bit key hashes."""

    def __init__(self, keys: np.ndarray, bits: int, number: int) -> None:
        self.bits, self.number, self.probes = bits, number, PROBES
        self.words = np.zeros(-(-bits // 64), dtype=_U)
        for at in self._places(keys):
            np.bitwise_or.at(self.words, at >> _U(6), _U(1) << (at & _U(63)))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for p in range(self.probes):
            yield mix(keys + _U((self.number * self.probes + p + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % _U(self.bits)

    def lets(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            ok &= (self.words[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)
        return ok


def has(levels: Sequence[Level], keys: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe: the first level that refuses a key decides."""
    listed = np.full(len(keys), len(levels) % 2 == 1)
    open_ = np.arange(len(keys))
    for k, level in enumerate(levels):
        lets = level.lets(keys[open_])
        listed[open_[~lets]] = k % 2 == 1
        open_ = open_[lets]
    return listed


def _candidates(host: str, path: str, lengths: Sequence[int]) -> list[tuple[str, str]]:
    """Longest keys first."""
    if not host:
        return []
    heads = [path[:n] for n in lengths if len(path) >= n]
    labels = host.split(".")
    found = [(".".join(labels[k:]), head) for k in range(len(labels)) for head in heads]
    return sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def build(pages: DataFrame, rules=RULES, url_col: str = "url") -> list[Level]:
    """The cascade over all keys that the urls can have."""
    ship(pages.sparkSession)
    lengths = sorted({len(p) for _, _, p in rules})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            keys = {key_hash(h + p) for u in rb.column(0).to_pylist() for h, p in _candidates(*parts(u), lengths)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.fromiter(keys, dtype=_U, count=len(keys)).view(np.int64))})

    universe = materialize(pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key long").distinct(), "urlkeys")
    listed = np.unique(np.array([key_hash(h + p) for _, h, p in rules], dtype=_U))
    size = universe.count()
    bits = max(LEAST_BITS, int(1.44 * len(listed) * max(2.0, math.log2(max(2, size / max(1, len(listed))))) * 4))
    while True:
        first = Level(listed, bits, 0)

        def wrong(frames: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            for rb in frames:
                keys = rb.column(0).to_numpy().view(_U)
                keys = keys[first.lets(keys)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[~np.isin(keys, listed)].view(np.int64))})

        through = materialize(universe.mapInArrow(wrong, "key long"), "wrong")
        if through.count() <= MOST_WRONG:
            break
        bits *= 4
    levels, inside = [first], listed
    outside = np.sort(np.array([r.key for r in through.collect()], dtype=np.int64).view(_U))  # at most MOST_WRONG
    while len(outside):
        level = Level(outside, max(LEAST_BITS, 8 * len(outside)), len(levels))
        levels.append(level)
        inside, outside = outside, inside[level.lets(inside)]
    return levels


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict)."""
    levels = build(pages, rules, url_col)
    lengths = sorted({len(p) for _, _, p in rules})
    found = {}  # what a listed key says; whether a key is listed, the cascade alone decides
    for verdict, host, path in rules:
        found.setdefault(key_hash(host + path), (host + path, verdict))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            got = [parts(u) for u in rb.column(1).to_pylist()]
            keys = [[key_hash(h + p) for h, p in _candidates(*x, lengths)] for x in got]
            flat = np.array([k for own in keys for k in own], dtype=_U)
            listed = iter(has(levels, flat).tolist())
            hits = [[k for k in own if next(listed)] for own in keys]
            if any(k not in found for own in hits for k in own):
                raise RuntimeError("the cascade lists a key that no rule has")
            said = [found[own[0]] if own else (None, default) for own in hits]
            cols = [[h for h, _ in got], [p for _, p in got], [r for r, _ in said], [v for _, v in said]]
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
