"""The byte-level BPE split pattern, in numpy over whole batches, and a cache of encoded pre-tokens.

The pattern's alternatives (contractions, ``" ?"`` before a run of letters,
numbers or other characters, white space that leaves its last character to
what follows) tile a text, so the starts of its matches describe the split.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from . import _text as X

#: Encoded pre-tokens that a Python worker keeps, at most; the cache starts anew beyond that.
CACHED = 1_500_000
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in [*range(0x32400), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    out[_WHITE] = 3
    return out


class Split(NamedTuple):
    start: np.ndarray  # byte positions; a match ends where the next one starts
    end: np.ndarray
    bounds: np.ndarray  # first match of each row, and the end


def split(part: X.Texts) -> Split:
    data, offsets = part.data, part.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Split(none, none, np.zeros(len(offsets), np.int64))
    if data.max() < 128:
        points, lead = data, None
        at = offsets
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(lead, offsets)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # of a row
    first[at[:-1]] = True
    first[n] = True
    turn = first.copy()
    turn[1:n] |= kind[1:] != kind[:-1]
    white = kind == 3
    start = turn[:n].copy()
    # the last white character before something else of the row starts a match
    before = white[:-1] & ~white[1:] & ~first[1:n]
    start[:-1] |= before
    # and a space there takes what follows with it
    start[1:] &= ~(before & (points[:-1] == 32))
    quote = np.flatnonzero((points == 39) & start & turn[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == 1) & ~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        rest = rest[rest < n]
        rest = rest[~turn[rest]]
        start[rest] = True
    chars = np.flatnonzero(start)
    begin = chars if lead is None else lead[chars]
    return Split(begin, np.append(begin[1:], len(data)), np.searchsorted(begin, offsets))


class Encoder:
    """Ids of whole batches; only pre-tokens that this process hasn't met reach ``encode``.

    A pre-token is found by its hash and then compared, byte for byte, with the
    one that was encoded.  Should two share a hash, that part is encoded anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], cached: int = CACHED):
        self.encode, self.cached = encode, cached
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.at, self.size, self.text_at, self.text_size = np.zeros(0, np.uint64), none, none, none, none
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 18, np.uint8), 0

    def _learn(self, key: np.ndarray, pieces: list[bytes]) -> None:
        found = self.encode(pieces)
        size = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        text_size = np.array([len(x) for x in pieces], np.int64)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        at, text_at = self.used + np.cumsum(size) - size, self.text_used + np.cumsum(text_size) - text_size
        self.ids, self.used = _appended(self.ids, self.used, flat)
        self.text, self.text_used = _appended(self.text, self.text_used, text)
        place = np.searchsorted(self.key, key)
        self.key, self.at, self.size = np.insert(self.key, place, key), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.text_at, self.text_size = np.insert(self.text_at, place, text_at), np.insert(self.text_size, place, text_size)

    def rows(self, part: X.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and ``rows + 1`` bounds."""
        found = split(part)
        if not len(found.start):
            return np.zeros(0, np.uint32), np.zeros(len(part.offsets), np.int64)
        key, index, inverse = np.unique(X.segment_hash(part.data, found.start, found.end), return_index=True, return_inverse=True)
        if len(self.key) + len(key) > self.cached:
            self.clear()
        place = np.searchsorted(self.key, key)
        new = self.key[np.minimum(place, len(self.key) - 1)] != key if len(self.key) else np.ones(len(key), bool)
        if new.any():
            raw = part.data.tobytes()
            lo, hi = found.start[index[new]].tolist(), found.end[index[new]].tolist()
            self._learn(key[new], [raw[a:b] for a, b in zip(lo, hi)])
            place = np.searchsorted(self.key, key)
        own = place[inverse]
        at, size = self.at[own], self.size[own]
        if not X.same_bytes(part.data, found.start, found.end, X.view(self.text, spare=True), self.text_at[own], self.text_at[own] + self.text_size[own]).all():
            return self._anew(part, found)
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[X.spread(at, size)], ends[found.bounds]

    def _anew(self, part: X.Texts, found: Split) -> tuple[np.ndarray, np.ndarray]:
        raw = part.data.tobytes()
        ids = self.encode([raw[a:b] for a, b in zip(found.start.tolist(), found.end.tolist())])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(ends[-1])), ends[found.bounds]


def _appended(held: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """The array with ``more`` from ``used`` on, made longer if it doesn't leave eight elements spare."""
    if used + len(more) + 8 > len(held):
        held = np.concatenate([held[:used], np.zeros(used + 2 * len(more) + 8, held.dtype)])
    held[used : used + len(more)] = more
    return held, used + len(more)
