"""Words of UTF-8 text on byte arrays: white space is \\x20 and \\x09-\\x0D, everything else is word.

Documents of a batch lie in one buffer, each followed by a newline, so no word crosses documents.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that are hashed at once, so that what they need stays in the cache.
CHUNK = 1 << 15
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * _K1 + mix(b + _K2))


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buffer, and where each document starts in it; one more entry for the end."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    return np.frombuffer(b"".join(x for t in texts for x in (t or b"", b"\n")) + bytes(8), dtype=np.uint8), at


def find_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and the first word's index of each document (one more for the end)."""
    solid = np.zeros(int(at[-1]) + 1, dtype=np.int8)
    solid[1:] = ~space[data[: at[-1]]]
    step = np.diff(solid)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, eight bytes a step. data ends in eight spare bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), CHUNK):
        out[k : k + CHUNK] = _hash_chunk(data, starts[k : k + CHUNK], ends[k : k + CHUNK], seed)
    return out


def _hash_chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    size = (ends - starts).astype(np.int64)
    window = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    out = mix(size.astype(_U) * _K1 + _U(seed & 0xFFFFFFFFFFFFFFFF))
    at, left, live = starts, size, None
    while len(at):
        got = window[at]
        short = left < 8
        got = np.where(short, got & ((_U(1) << (left.clip(0, 7).astype(_U) << _U(3))) - _U(1)), got)
        if live is None:
            out = mix(out ^ (got * _K1 + _K2))
            live = np.flatnonzero(left > 8)
        else:
            out[live] = mix(out[live] ^ (got * _K1 + _K2))
            live = live[left > 8]
        at, left = at[left > 8] + 8, left[left > 8] - 8
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own goes through a hash table, which is slow for many large values."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each is among them; in less memory than numpy's own."""
    order = np.argsort(x)
    s = x[order]
    head = np.ones(len(s), dtype=bool)
    np.not_equal(s[1:], s[:-1], out=head[1:])
    s = s[head]
    number = np.cumsum(head, dtype=np.int32) - np.int32(1)
    where = np.empty(len(x), dtype=np.int32)
    where[order] = number
    return s, where
