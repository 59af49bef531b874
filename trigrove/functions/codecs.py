"""Variable-length integers, posting lists and deletion bitmaps as bytes, one at a time or in numpy passes (stored tables use Parquet's own encodings)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def varint(number: int) -> bytes:
    """Little-endian groups of seven bits; all but the last have the top bit set."""
    out = bytearray()
    while number > 0x7F:
        out.append(number & 0x7F | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def varint_size(number: int) -> int:
    return max(1, -(-number.bit_length() // 7))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a position, and the position after it."""
    number = shift = 0
    while True:
        byte = data[at]
        at += 1
        number |= (byte & 0x7F) << shift
        if byte < 0x80:
            return number, at
        shift += 7


def encode_postings(ids: Iterable[int]) -> bytes:
    """Sorted ids as gaps plus one, closed by a zero."""
    out, last = bytearray(), -1
    for i in sorted(ids):
        out += varint(i - last)
        last = i
    return bytes(out) + b"\0"


def decode_postings(data: bytes) -> list[int]:
    out, at, last = [], 0, -1
    while True:
        gap, at = read_varint(data, at)
        if not gap:
            return out
        last += gap
        out.append(last)


def varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many numbers (not negative), one after the other, and how many bytes each takes."""
    left = numbers.astype(np.uint64)
    sizes = np.ones(len(left), np.int64)
    k = 7
    while len(left) and k < 64 and (more := left >> np.uint64(k) > 0).any():
        sizes += more
        k += 7
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[at[own] + k] = (left[own] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | ((sizes[own] > k + 1).astype(np.uint8) << 7)
    return out, sizes


def read_varints(data: np.ndarray) -> np.ndarray:
    """The numbers whose bytes follow each other."""
    ends = np.flatnonzero(data < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts + 1
    out = (data[starts] & 0x7F).astype(np.uint64)
    for k in range(1, int(sizes.max(initial=0))):
        own = sizes > k
        out[own] |= (data[starts[own] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


class Bitmap:
    """Which documents of a segment are deleted; ids beyond the segment count as deleted."""

    def __init__(self, size: int, bits: bytes | None = None):
        self.size = size
        self.bits = bytearray(bits if bits is not None else bytes(-(-size // 8)))

    def delete(self, i: int) -> None:
        self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, i: int) -> bool:
        return i >= self.size or bool(self.bits[i >> 3] >> (i & 7) & 1)

    def __len__(self) -> int:
        return sum(b.bit_count() for b in self.bits)

    def to_bytes(self) -> bytes:
        return self.size.to_bytes(4, "big") + len(self).to_bytes(4, "big") + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> Bitmap:
        return cls(int.from_bytes(data[:4], "big"), data[8:])
