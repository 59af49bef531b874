"""Whole-batch text scanning over Arrow string buffers, without a Python object per row.

An Arrow string column is one byte buffer and an offset per row, so words,
lines and their hashes come from a handful of numpy passes over that buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once; one longer text is scanned alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    """Some rows: their bytes, one after the other, and ``len(rows) + 1`` offsets."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # of these rows in the batch


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """A string column in runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of each word
    bounds: np.ndarray  # first word of each row, and the end
    hash: np.ndarray


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + size`` of each pair, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def view(data: np.ndarray, spare: bool = False) -> np.ndarray:
    """The eight bytes from each byte on as a number; ``spare``: eight bytes more than used are there already."""
    if not spare:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        data = padded
    return np.ndarray(len(data) - 7, "<u8", data.data, 0, (1,))


def _blocks(every: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of segments as 64-bit numbers, the last one of a segment filled up with zeros, and how many each has."""
    count = -(-(end - start) // 8)
    last = np.cumsum(count) - 1
    place = np.arange(int(last[-1]) + 1 if len(last) else 0) - np.repeat(last + 1 - count, count)
    value = every[np.repeat(start, count) + 8 * place]
    full = count > 0
    tail = (end - start - 8 * (count - 1))[full]
    value[last[full]] &= ~_U(0) >> (_U(8) * (8 - tail).astype(_U))
    return value, count


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte segments (in order, not overlapping): equal bytes, equal values, in every process.

    Eight bytes at a time are mixed with their place in the segment before they
    are added up, so no arithmetic relation between texts makes two hashes meet.
    Values are of 64 bits all the same: where equality must be certain, callers
    compare the bytes too (:func:`same_bytes`).
    """
    if len(data) <= 4 * CHUNK_BYTES or len(start) < 2:
        return _hashes(data, start, end, seed)
    out, at = np.empty(len(start), _U), 0
    while at < len(start):  # a long text's segments go by runs of about a chunk
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        base = start[at]
        out[at:to] = _hashes(data[base : end[to - 1]], start[at:to] - base, end[at:to] - base, seed)
        at = to
    return out


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, _U)
    value, count = _blocks(view(data), start, end)
    salt = _U((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    value *= _U(0xD1342543DE82EF95)
    value += salt
    if len(value) == len(start) and (count == 1).all():
        total = mix(value)
    else:
        first = np.cumsum(count) - count
        value += (np.arange(len(value)) - np.repeat(first, count)).astype(_U) * _BASE
        sums = np.zeros(len(value) + 1, _U)
        np.cumsum(mix(value), out=sums[1:])
        total = sums[first + count] - sums[first]
    return mix(total + (end - start).astype(_U) * _BASE)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray | None, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether each segment of ``data`` equals, byte for byte, its partner in ``other`` (a :func:`view`; None: in ``data``)."""
    size = end - start
    same = size == end2 - start2
    at = np.flatnonzero(same & (size > 0))
    if not len(at):
        return same
    one = view(data)
    two = one if other is None else other
    run = np.cumsum(size[at]) // (4 * CHUNK_BYTES)  # long segments are compared a few at a time
    for own in np.split(at, np.flatnonzero(np.diff(run)) + 1) if run[-1] else [at]:
        value, count = _blocks(one, start[own], end[own])
        differ = value != _blocks(two, start2[own], end2[own])[0]
        same[own] = np.add.reduceat(differ, np.cumsum(count) - count) == 0
    return same


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Numbers from 0 for segments, equal where their bytes are equal and nowhere else, and how many there are."""
    key = segment_hash(data, start, end) if hashes is None else hashes
    _, index, found = np.unique(key, return_index=True, return_inverse=True)
    found = found.reshape(-1)
    rest = np.flatnonzero(index[found] != np.arange(len(found)))
    first = index[found[rest]]
    if same_bytes(data, start[rest], end[rest], None, start[first], end[first]).all():
        return found, len(index)
    raw, seen = data.tobytes(), {}  # two texts of one hash: rarer than any test will see, yet settled by the bytes
    return np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist())], np.int64), len(seen)


def words(part: Texts, lower: bool = False) -> Words:
    """Maximal runs of bytes other than ASCII white space, row by row."""
    data, offsets = part.data, part.offsets
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, _U))
    inside = ~SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edge] = inside[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[edge] = inside[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(start, end, row, bounds, segment_hash(LOWER[data] if lower else data, start, end))


def lines(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each ``\\n``-split line of the rows that have a byte."""
    data, offsets = part.data, part.offsets
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    breaks = np.flatnonzero(data == 10)
    # a break ends a line and the next byte starts one, unless the row ends there: then that line is empty
    start = np.concatenate([offsets[:-1][full], breaks + 1])
    end = np.concatenate([breaks, offsets[1:][full]])
    start.sort(kind="stable")
    end.sort(kind="stable")
    row = np.repeat(full, 1 + np.diff(np.searchsorted(breaks, offsets))[full])
    return start, end, row


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n) if len(row) else np.zeros(n)


def counted_prefix(flags: np.ndarray) -> np.ndarray:
    """Running sums with a leading 0, for counts between offsets."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out
