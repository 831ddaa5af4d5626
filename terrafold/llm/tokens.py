"""Token ids of whole texts by a tokenizers file, encoded once per distinct unit.

Both kinds of file split a text before they merge bytes, and no merge crosses the split. A unit is what
surely lies between splits: a word for files that drop white space, a run of white space with the word
after it for byte-level files. Units are found, hashed (twice 64 bits) and made distinct on arrays; a bounded
cache of sorted hashes has the ids of units seen before, and the library encodes the others. A text for which
a unit could differ from its context (white space beyond ASCII next to a unit's edge) is encoded as a whole.

The string of an added token inside a text is that token, as the library has it by default: the library cuts texts
there before anything else, so the parts between are encoded like texts, and the token's id stands between them.
A file whose added tokens do more than that (strip white space, ask for word borders, match normalised text) has
every text that may hold one encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from terrafold.llm.words import find_words, hash_words, join_texts

#: Units and bytes of the cache, text bytes of a slice, and text bytes that the library encodes at once: it has some 100 bytes for an id.
CACHE_UNITS, CACHE_BYTES, SLICE_BYTES, BLOCK_BYTES = 400_000, 24 << 20, 4 << 20, 1 << 18
#: Bytes of a unit in the cache besides its ids.
UNIT_BYTES = 37
#: A unit that came again in a later slice stays as long as one that was used so many slices after it.
AGAIN = 64
#: UTF-8 of white space beyond ASCII, and of the ASCII separators 1C-1F.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


#: Units of Latin letters and at most one mark; many go to the library as one text, since their ids can be told apart.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_WORD, _SPACED = re.compile(_LETTERS + "([.,]?)"), re.compile(" " + _LETTERS + "[.,]?")
GROUP = 256


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _blocks(units: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The units in lists of about BLOCK_BYTES."""
    held: list[bytes] = []
    size = 0
    for u in units:
        held.append(u)
        size += len(u) + 16
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder:
    """ids of texts as unsigned 32-bit arrays."""

    def __init__(self, path: str, drops_space: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        longest = b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))
        self.cut = re.compile(b"(" + longest + b")") if added and plain else None
        self.odd = re.compile(longest, re.I) if added and not plain else None
        self.clock = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if drops_space else t.startswith("\u0120"))]] = True
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, bool))

    def _keep(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray, used: np.ndarray, again: np.ndarray) -> None:
        self.key, self.check, self.size, self.ids, self.used, self.again = key, check, size, ids, used, again
        self.start = np.cumsum(size) - size

    def _select(self, rows: np.ndarray) -> None:
        ids = self.ids[_ranges(self.start[rows], self.size[rows])]
        self._keep(self.key[rows], self.check[rows], self.size[rows], ids, self.used[rows], self.again[rows])

    def _encode(self, units: list[bytes]) -> list[np.ndarray]:
        return [ids for block in _blocks(units) for ids in self._library([u.decode("utf-8", "replace") for u in block])]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, group: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of units encoded as one text. A word's last id ends a word, a spaced unit's first id has the space."""
        ids = np.array(self.tokenizer.encode((" " if self.drops_space else "").join(group), add_special_tokens=False).ids, dtype=np.uint32)
        mark = np.flatnonzero(self.edge[ids])
        if self.drops_space:
            splits = np.cumsum([2 if u[-1] in ".," else 1 for u in group])
            if len(mark) != splits[-1] or mark[-1] != len(ids) - 1:
                return None
            return np.diff(mark[splits - 1] + 1, prepend=0), ids
        if len(mark) != len(group) or mark[0]:
            return None
        return np.diff(np.append(mark, len(ids))), ids

    def _units(self, units: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids, one after the other, of all units."""
        sizes, ids = zip(*map(self._block, _blocks(units)), strict=True)
        return np.concatenate(sizes), np.concatenate(ids)

    def _block(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode("utf-8", "replace") for u in units]
        match = (_WORD if self.drops_space else _SPACED).fullmatch
        easy = np.array([match(t) is not None for t in texts])
        order, sizes, ids = [], [], []
        rest = np.flatnonzero(~easy).tolist()
        plain = np.flatnonzero(easy).tolist()
        for k in range(0, len(plain), GROUP):
            group = plain[k : k + GROUP]
            got = self._plain([texts[i] for i in group])
            if got is None:
                rest += group
                continue
            order += group
            sizes.append(got[0])
            ids.append(got[1])
        if rest:
            new = self._library([texts[i] for i in rest])
            order += rest
            sizes.append(np.array([len(x) for x in new], dtype=np.int64))
            ids.append(np.concatenate(new))
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        back = np.argsort(np.array(order), kind="stable")
        return size[back], flat[_ranges((np.cumsum(size) - size)[back], size[back])]

    def _add(self, key: np.ndarray, check: np.ndarray, units: Iterable[bytes]) -> None:
        """key is sorted and none of it is in the cache."""
        sizes, flat = self._units(units)
        held = UNIT_BYTES * (len(self.key) + len(key)) + 4 * (len(self.ids) + len(flat))
        if (len(self.key) + len(key) > CACHE_UNITS or held > CACHE_BYTES) and len(self.key):
            needed = int((self.used == self.clock).sum())  # units of this slice stay in any case
            rank = np.where(self.used == self.clock, np.iinfo(np.int32).max, self.used + AGAIN * self.again)
            recent = np.argsort(-rank, kind="stable")
            fit = int(np.searchsorted(np.cumsum(UNIT_BYTES + 4 * self.size[recent]), CACHE_BYTES // 2, "right"))
            self._select(np.sort(recent[: max(min(CACHE_UNITS // 2, fit), needed)]))
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        size = np.concatenate([self.size, sizes])
        start = np.concatenate([self.start, np.cumsum(sizes) - sizes + len(self.ids)])
        ids = np.concatenate([self.ids, flat])[_ranges(start[order], size[order])]
        used = np.concatenate([self.used, np.full(len(key), self.clock, np.int32)])
        again = np.concatenate([self.again, np.zeros(len(key), bool)])
        self._keep(np.concatenate([self.key, key])[order], np.concatenate([self.check, check])[order], size[order], ids, used[order], again[order])

    def _slice(self, texts: list[bytes | None]) -> list[np.ndarray]:
        self.clock += 1
        data, at = join_texts(texts)
        starts, ends, first = find_words(data, at)
        if not self.drops_space:
            # a unit begins where the word before ends; what follows the last word is one too
            n = np.diff(first)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
            starts[first[:-1][n > 0]] = at[:-1][n > 0]
            last = at[:-1].copy()
            last[n > 0] = ends[first[1:][n > 0] - 1]
            tail = np.flatnonzero(last < at[1:] - 1)
            starts = np.insert(starts, first[1:][tail], last[tail])
            ends = np.insert(ends, first[1:][tail], at[1:][tail] - 1)
            first = first + np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(texts)))])
        hashes, checks = hash_words(data, starts, ends), hash_words(data, starts, ends, 0x7F4A7C15)
        keys, one, where = np.unique(hashes, return_index=True, return_inverse=True)
        if not np.array_equal(checks[one][where], checks):  # two units of one hash: take the long way
            return self._encode([t or b"" for t in texts])
        spot = np.searchsorted(self.key, keys).clip(0, max(len(self.key) - 1, 0))
        same = self.key[spot] == keys if len(self.key) else np.zeros(len(keys), dtype=bool)
        known = same.copy()
        known[same] = self.check[spot[same]] == checks[one[same]]
        self.used[spot[known]], self.again[spot[known]] = self.clock, True
        if not known.all():
            raw = data.tobytes()
            new = one[~known]
            clash = same & ~known
            if clash.any():  # another unit of the same hash has to go
                stay = np.ones(len(self.key), dtype=bool)
                stay[spot[clash]] = False
                self._select(np.flatnonzero(stay))
            self._add(keys[~known], checks[new], (raw[a:b] for a, b in zip(starts[new], ends[new], strict=True)))
            del raw
            spot = np.searchsorted(self.key, keys)
        size = self.size[spot][where]
        ids = self.ids[_ranges(self.start[spot][where], size)]
        edge = np.concatenate([[0], np.cumsum(size)])[first]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _spaced(self, text: bytes) -> bool:
        return not self.drops_space and _OTHER_SPACE.search(text) is not None

    def encode(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """In order, by slices of bounded bytes."""
        held: list[bytes | None] = []
        whole: dict[int, bytes] = {}
        cuts: dict[int, list[bytes]] = {}  # texts that hold added tokens: their parts, in turn with the tokens
        size = 0

        def flush() -> Iterator[np.ndarray]:
            pieces = [x for parts in cuts.values() for x in parts[::2]]
            got = self._slice([*held, *pieces])
            odd = [*whole, *(k for k, x in enumerate(pieces, len(held)) if self._spaced(x))]
            if odd:
                texts = [*whole.values(), *(pieces[k - len(held)] for k in odd[len(whole) :])]
                for i, ids in zip(odd, self._encode(texts), strict=True):
                    got[i] = ids
            rest = iter(got[len(held) :])
            for i, parts in cuts.items():
                ids = [np.array([self.added[x]], dtype=np.uint32) if k % 2 else next(rest) for k, x in enumerate(parts)]
                got[i] = np.concatenate(ids)
            yield from got[: len(held)]

        for t in texts:
            if t and self.cut and self.cut.search(t):
                cuts[len(held)] = self.cut.split(t)
                held.append(None)
            elif t and (self._spaced(t) or (self.odd and self.odd.search(t))):
                whole[len(held)] = t
                held.append(None)
            else:
                held.append(t)
            size += len(t) if t else 0
            if size >= SLICE_BYTES:
                yield from flush()
                held, whole, cuts, size = [], {}, {}, 0
        if held:
            yield from flush()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder for a file."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
