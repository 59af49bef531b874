"""Progressive JPEG in numpy: an encoder of coefficient arrays and a decoder to RGB tensors.

The decoder reads frames with Huffman-coded progressive scans: spectral
selection, successive approximation, end-of-band runs, restart intervals and
subsampled components.  Entropy-coded bits are sequential, but restart segments
are not: the segments of a scan kind, over all images of a batch, are lanes that
step through their symbols together.  Scans accumulate into one coefficient
array; the inverse transform, chroma upsampling and colour conversion follow in
exact integer arithmetic, so equal bytes give equal tensors in any batch.

The encoder stores given coefficients losslessly (unit quantisation) in nine
scans, with a restart marker every :data:`RESTART` units for the decoder's sake.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Units between the encoder's restart markers.
RESTART = 8
BANDS = ((1, 20), (21, 63))

ZIGZAG = np.array(sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i % 8 if s % 2 == 0 else i // 8)))
_U = np.uint64


# --- Huffman tables


class Huffman(NamedTuple):
    counts: bytes  # of codes by length 1..16
    symbols: bytes
    code: np.ndarray  # by symbol
    size: np.ndarray
    lookup: np.ndarray  # by the next 16 bits: size << 8 | symbol; 0: no code


@lru_cache(64)
def table(counts: bytes, symbols: bytes) -> Huffman:
    code, size, lookup = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.int64)
    value = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            s = symbols[at]
            code[s], size[s] = value, bits
            lookup[value << 16 - bits : value + 1 << 16 - bits] = bits << 8 | s
            value += 1
            at += 1
        value <<= 1
    return Huffman(counts, symbols, code, size, lookup)


def _built(weights: dict[int, float]) -> Huffman:
    """A table of at most 16 bits a code that leaves the code of all ones free."""
    heap = [(w, s, {s: 0}) for s, w in weights.items()] + [(0.0, 999, {999: 0})]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, min(i, j), {s: d + 1 for s, d in (x | y).items()}))
    depth = heap[0][2]
    longest = max(depth.values())
    assert longest <= 16 and depth[999] == longest
    del depth[999]
    order = sorted(depth, key=lambda s: (depth[s], s))
    return table(bytes(sum(d == n for d in depth.values()) for n in range(1, 17)), bytes(order))


@lru_cache(1)
def standard() -> tuple[Huffman, Huffman]:
    """The encoder's DC and AC tables, fitted to text bytes as coefficients."""
    first = {4: 0.45, 3: 0.2, 6: 0.15, 5: 0.1, 2: 0.02, 1: 0.01, 7: 0.01}
    ac = {r << 4 | s: max(2.0**-12, first.get(s, 0) * (1 if r == 0 else 0.01)) for r in range(16) for s in range(1, 11)}
    ac |= {0x00: 0.02, 0xF0: 2.0**-12} | {n << 4: 2.0**-12 for n in range(1, 15)}
    return _built({s: 0.5 ** abs(s - 6) for s in range(12)}), _built(ac)


# --- frames


class Frame(NamedTuple):
    width: int
    height: int
    ids: tuple[int, ...]
    sampling: tuple[tuple[int, int], ...]  # across, down, of each component
    quant: tuple[int, ...]

    def units(self) -> tuple[int, int]:
        across, down = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        return -(-self.width // (8 * across)), -(-self.height // (8 * down))

    def grid(self, c: int) -> tuple[int, int]:
        """Block columns and rows of a component, padded to whole units."""
        mw, mh = self.units()
        return mw * self.sampling[c][0], mh * self.sampling[c][1]

    def order(self, components: tuple[int, ...]) -> np.ndarray:
        """Blocks in the order of a scan; blocks are numbered component by component, row by row."""
        bases = np.concatenate([[0], np.cumsum([np.prod(self.grid(c)) for c in range(len(self.ids))])])
        if len(components) == 1:
            c = components[0]
            across, down = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
            wide = -(-(-(-self.width * self.sampling[c][0] // across)) // 8)
            high = -(-(-(-self.height * self.sampling[c][1] // down)) // 8)
            return (bases[c] + np.arange(high)[:, None] * self.grid(c)[0] + np.arange(wide)).ravel()
        mw, mh = self.units()
        parts = []
        for c in components:
            h, v = self.sampling[c]
            rows = (np.arange(mh)[:, None] * v + np.arange(v))[:, None, :, None]
            columns = (np.arange(mw)[:, None] * h + np.arange(h))[None, :, None, :]
            parts.append((bases[c] + rows * self.grid(c)[0] + columns).reshape(mw * mh, h * v))
        return np.concatenate(parts, 1).ravel()

    def blocks(self) -> int:
        return int(sum(np.prod(self.grid(c)) for c in range(len(self.ids))))


@lru_cache(256)
def _order(frame: Frame, components: tuple[int, ...]) -> np.ndarray:
    return frame.order(components)


# --- encoding


def _packed(code: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the codes (up to 32 bits, in order), each segment filled up with ones; bytes of each segment."""
    bits = np.bincount(segment, size, segments).astype(np.int64)
    length = bits + 7 >> 3
    base = np.cumsum(length) - length
    ends = np.cumsum(size)
    at = ends - size
    first = np.searchsorted(segment, np.arange(segments))
    at = at - at[first][segment] + base[segment] * 8
    word = at >> 5
    window = code.astype(_U) << (64 - (at & 31) - size).astype(_U)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums = np.add.reduceat(window, start)
    out = np.zeros((int(length.sum()) >> 2) + 3, np.uint32)
    own = word[start]
    out[own] += (sums >> _U(32)).astype(np.uint32)
    out[own + 1] += (sums & _U(0xFFFFFFFF)).astype(np.uint32)
    raw = out.astype(">u4").view(np.uint8)[: int(length.sum())].copy()
    raw[base + length - 1] |= ((1 << (-bits & 7)) - 1).astype(np.uint8)
    return raw, length


def _framed(raw: np.ndarray, length: np.ndarray, image: np.ndarray, images: int) -> list[bytes]:
    """Each image's segments with stuffed bytes, and restart markers between them."""
    first = np.concatenate([[True], image[1:] != image[:-1]])
    number = np.arange(len(image)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    full = raw == 255
    before = np.cumsum(full) - full
    place = np.arange(len(raw)) + before + np.repeat(2 * np.cumsum(~first), length)
    out = np.zeros(len(raw) + int(full.sum()) + 2 * int((~first).sum()), np.uint8)
    out[place] = raw
    base = np.cumsum(length) - length
    mark = place[base[~first]]
    out[mark - 2] = 255
    out[mark - 1] = 0xD0 + (number[~first] - 1) % 8
    edges = np.append(place[base[first]], len(out)).tolist()
    data = out.tobytes()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def _category(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1]


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _ac_first(block: np.ndarray, band: tuple[int, int], low: int, ac: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, size and block of each event of a first scan of a band."""
    lo, hi = band
    part = block[:, lo : hi + 1].astype(np.int64)
    part = np.where(part < 0, -(-part >> low), part >> low)
    row, column = np.nonzero(part)
    v = part[row, column]
    last = np.full(len(v), -1)
    last[1:] = np.where(row[1:] == row[:-1], column[:-1], -1)
    run = column - last - 1
    s = _category(v)
    symbol = (run & 15) << 4 | s
    code, size = (ac.code[symbol] << s) | _magnitude(v, s), ac.size[symbol] + s
    ends = np.searchsorted(row, np.arange(len(block)), "right")
    full = np.zeros(len(block), bool)
    full[row[column == hi - lo]] = True
    open_ = np.flatnonzero(~full)
    far = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
    where = np.concatenate([ends[open_], far])
    what = np.concatenate([np.zeros(len(open_), np.int64), np.full(len(far), 0xF0)])
    return np.insert(code, where, ac.code[what]), np.insert(size, where, ac.size[what]), np.insert(row, where, np.concatenate([open_, row[far]]))


def _ac_refine(block: np.ndarray, low: int, ac: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a refinement of the band 1..63 by one bit."""
    part = np.abs(block[:, 1:].astype(np.int64)) >> low
    old, new = part > 1, part == 1
    bit = part & 1
    plain = ~new.any(1) & old.all(1)
    at = np.flatnonzero(plain)
    weights = (1 << np.arange(31, -1, -1)).astype(float)
    high = (bit[at, :32] @ weights).astype(np.int64)
    rest = (bit[at, 32:] @ weights[1:]).astype(np.int64)
    n = len(at)
    keys = [at * 200, at * 200 + 1, at * 200 + 2]
    codes = [np.full(n, ac.code[0]), high, rest]
    sizes = [np.full(n, ac.size[0]), np.full(n, 32), np.full(n, 31)]
    at = np.flatnonzero(~plain)
    if len(at):
        old, new, bit, sign = old[at], new[at], bit[at], block[at, 1:] >= 0
        zero = ~old & ~new
        count = np.cumsum(zero, 1)
        base = np.maximum.accumulate(np.where(new, count, 0), 1)
        base = np.concatenate([np.zeros((len(at), 1), np.int64), base[:, :-1]], 1)
        later = np.logical_or.accumulate(new[:, ::-1], 1)[:, ::-1]
        skip = zero & ((count - base) % 16 == 0) & later
        stop = skip | new
        column = np.broadcast_to(np.arange(63), stop.shape)
        follow = np.minimum.accumulate(np.where(stop, column, 63)[:, ::-1], 1)[:, ::-1]
        r, c = np.nonzero(skip)
        order = [(at[r], c, np.full(len(r), -1), np.full(len(r), ac.code[0xF0]), np.full(len(r), ac.size[0xF0]))]
        r, c = np.nonzero(new)
        symbol = (((count - base)[r, c] % 16) << 4) | 1
        order.append((at[r], c, np.full(len(r), -1), ac.code[symbol] << 1 | sign[r, c], ac.size[symbol] + 1))
        r, c = np.nonzero(old)
        order.append((at[r], follow[r, c], c, bit[r, c], np.ones(len(r), np.int64)))
        r = np.flatnonzero(~new[:, 62])
        order.append((at[r], np.full(len(r), 63), np.full(len(r), -1), np.full(len(r), ac.code[0]), np.full(len(r), ac.size[0])))
        b, e, p, code, size = (np.concatenate(x) for x in zip(*order))
        by = np.lexsort((p, e, b))
        b, code, size = b[by], code[by], size[by]
        keys.append(b * 200 + 3)
        codes.append(code)
        sizes.append(size)
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    return np.concatenate(codes)[by], np.concatenate(sizes)[by], key[by] // 200


def _marker(kind: int, body: bytes) -> bytes:
    return bytes((255, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def encode(frames: list[Frame], coefficients: list[np.ndarray], notes: list[bytes]) -> list[bytes]:
    """Progressive files of the images' coefficients (blocks x 64, zigzag order), each with a comment."""
    dc, ac = standard()
    images = len(frames)
    bases = np.concatenate([[0], np.cumsum([len(c) for c in coefficients])])
    every = np.concatenate(coefficients).astype(np.int32)
    components = tuple(range(len(frames[0].ids)))

    def scan(own: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks in order, their segments, the segments' images, and the places in the unit."""
        orders = [_order(f, own) for f in frames]
        unit = 1 if len(own) == 1 else sum(h * v for h, v in (frames[0].sampling[c] for c in own))
        per = RESTART * unit
        blocks = np.concatenate([o + b for o, b in zip(orders, bases)])
        sizes = np.array([len(o) for o in orders])
        segments = -(-sizes // per)
        inside = np.arange(len(blocks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = inside // per + np.repeat(np.cumsum(segments) - segments, sizes)
        return blocks, segment, np.repeat(np.arange(images), segments), inside % unit

    def finished(code: np.ndarray, size: np.ndarray, segment: np.ndarray, image: np.ndarray) -> list[bytes]:
        return _framed(*_packed(code, size, segment, len(image)), image, images)

    kinds = [np.repeat(c, f) for c, f in ((c, frames[0].sampling[c][0] * frames[0].sampling[c][1]) for c in components)]
    kind = np.concatenate(kinds)
    parts: list[tuple[bytes, list[bytes]]] = []
    head = lambda own, lo, hi, high, low: _marker(0xDA, bytes([len(own)]) + b"".join(bytes((frames[0].ids[c], 0)) for c in own) + bytes((lo, hi, high << 4 | low)))
    blocks, segment, image, place = scan(components)
    v = every[blocks, 0] >> 1
    past = np.zeros(len(v), np.int64)
    for c in components:
        mine = np.flatnonzero(kind[place] == c)
        same = segment[mine][1:] == segment[mine][:-1]
        past[mine[1:][same]] = v[mine[:-1][same]]
    step = v - past
    s = _category(step)
    parts.append((head(components, 0, 0, 0, 1), finished(dc.code[s] << s | _magnitude(step, s), dc.size[s] + s, segment, image)))
    single = [scan((c,)) for c in components]
    for band in BANDS:
        for c, (b, g, im, _) in zip(components, single):
            code, size, row = _ac_first(every[b], band, 1, ac)
            parts.append((head((c,), *band, 0, 1), finished(code, size, g[row], im)))
    parts.append((head(components, 0, 0, 1, 0), finished(every[blocks, 0] & 1, np.ones(len(blocks), np.int64), segment, image)))
    for c, (b, g, im, _) in zip(components, single):
        code, size, row = _ac_refine(every[b], 0, ac)
        parts.append((head((c,), 1, 63, 1, 0), finished(code, size, g[row], im)))
    tables = _marker(0xDB, b"\0" + b"\1" * 64) + _marker(0xC4, b"\0" + dc.counts + dc.symbols) + _marker(0xC4, b"\x10" + ac.counts + ac.symbols) + _marker(0xDD, RESTART.to_bytes(2, "big"))
    out = []
    for i, f in enumerate(frames):
        frame = b"\x08" + f.height.to_bytes(2, "big") + f.width.to_bytes(2, "big") + bytes([len(f.ids)]) + b"".join(bytes((k, h << 4 | w, q)) for k, (h, w), q in zip(f.ids, f.sampling, f.quant))
        out.append(b"\xff\xd8" + _marker(0xFE, notes[i]) + tables + _marker(0xC2, frame) + b"".join(h + body[i] for h, body in parts) + b"\xff\xd9")
    return out


# --- decoding

_ENTROPY_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")


class Scan(NamedTuple):
    components: tuple[int, ...]
    dc: tuple[Huffman | None, ...]
    ac: Huffman | None
    band: tuple[int, int]
    high: int
    low: int
    restart: int
    data: bytes


class Image(NamedTuple):
    frame: Frame
    quant: dict[int, np.ndarray]
    scans: list[Scan]
    note: bytes


@lru_cache(64)
def _quantisation(body: bytes) -> dict[int, np.ndarray]:
    out, k = {}, 0
    while k < len(body):
        wide = body[k] >> 4
        n = 64 << wide
        out[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else "u1").astype(np.int64)
        k += 1 + n
    return out


@lru_cache(64)
def _tables(body: bytes) -> dict[int, Huffman]:
    out, k = {}, 0
    while k < len(body):
        counts = body[k + 1 : k + 17]
        n = sum(counts)
        out[body[k]] = table(counts, body[k + 17 : k + 17 + n])
        k += 17 + n
    return out


@lru_cache(256)
def _frame(body: bytes) -> Frame:
    rows = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
    return Frame(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), tuple(r[0] for r in rows), tuple((r[1] >> 4, r[1] & 15) for r in rows), tuple(r[2] for r in rows))


def parse(data: bytes) -> Image:
    """Headers and entropy-coded data of one file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, restart, note = 2, None, 0, b""
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, Huffman] = {}
    scans: list[Scan] = []
    while at < len(data):
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            quant.update(_quantisation(body))
        elif kind == 0xC4:
            tables.update(_tables(body))
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            note = body
        elif kind == 0xC2:
            frame = _frame(body)
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError(f"not a progressive Huffman frame: {kind:x}")
        elif kind == 0xDA:
            assert frame is not None
            n = body[0]
            own = tuple(frame.ids.index(body[1 + 2 * i]) for i in range(n))
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            end = _ENTROPY_END.search(data, at)
            stop = end.start() if end else len(data)
            dc = tuple(tables.get(body[2 + 2 * i] >> 4) for i in range(n))
            scans.append(Scan(own, dc, tables.get(0x10 | body[2] & 15), (lo, hi), bits >> 4, bits & 15, restart, data[at:stop]))
            at = stop
    if frame is None:
        raise ValueError("no frame")
    return Image(frame, quant, scans, note)


class _Lanes(NamedTuple):
    """Restart segments side by side."""

    window: np.ndarray  # 64 bits from each byte on
    at: np.ndarray  # bit positions
    blocks: np.ndarray  # of all lanes, in order
    first: np.ndarray  # of each lane
    count: np.ndarray


def _lanes(group: list[tuple[Scan, Frame, int]]) -> _Lanes:
    blocks, first, count, lost = [], [], [], []
    total = at = 0
    for scan, frame, base in group:
        order = _order(frame, scan.components)
        unit = 1 if len(scan.components) == 1 else sum(h * v for h, v in (frame.sampling[c] for c in scan.components))
        per = scan.restart * unit or len(order)
        starts = np.arange(-(-len(order) // per)) * per
        blocks.append(order + base)
        first.append(starts + total)
        count.append(np.minimum(per, len(order) - starts))
        lost.append(at)
        total += len(order)
        at += len(scan.data)
    raw = np.frombuffer(b"".join(s.data for s, _, _ in group) + bytes(16), np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    place = np.cumsum(keep) - keep
    edges = np.array(lost, np.int64)
    begin = np.sort(np.concatenate([edges, marks + 2]))
    # a scan whose markers aren't those expected keeps its first segments; segments that lack are empty
    have = np.diff(np.append(np.searchsorted(begin, edges), len(begin)))
    want = np.array([len(f) for f in first])
    if (have != want).any():
        rows = np.split(begin, np.cumsum(have)[:-1])
        begin = np.concatenate([np.append(r[:w], np.full(max(0, w - len(r)), len(raw) - 16)) for r, w in zip(rows, want)])
    raw = raw[keep].astype(_U)
    half = np.zeros(len(raw) - 4, _U)
    for i in range(4):
        half |= raw[i : i + len(half)] << _U(24 - 8 * i)
    window = half[:-4] << _U(32) | half[4:]
    return _Lanes(window, place[begin] * 8, np.concatenate(blocks), np.concatenate(first), np.concatenate(count))


def _peek(lanes: _Lanes, at: np.ndarray) -> np.ndarray:
    """The next 57 bits or more, at the top of a word; zeros beyond the data."""
    return lanes.window[np.minimum(at >> 3, len(lanes.window) - 1)] << (at & 7).astype(_U)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _dc_first(lanes: _Lanes, scan: Scan, frame: Frame, out: np.ndarray) -> None:
    own = np.arange(len(scan.components)) if len(scan.components) == 1 else np.repeat(np.arange(len(scan.components)), [frame.sampling[c][0] * frame.sampling[c][1] for c in scan.components])
    at, past = lanes.at.copy(), np.zeros((len(scan.components), len(lanes.at)), np.int64)
    for t in range(int(lanes.count.max())):
        live = np.flatnonzero(lanes.count > t)
        c = int(own[t % len(own)])
        word = _peek(lanes, at[live])
        found = scan.dc[c].lookup[(word >> _U(48)).astype(np.int64)]  # type: ignore[union-attr]
        bits, size = found >> 8, found & 255
        raw = ((word << bits.astype(_U)) >> _U(1) >> (63 - size).astype(_U)).astype(np.int64)
        past[c, live] += _extended(raw, size)
        at[live] += bits + size
        out[lanes.blocks[lanes.first[live] + t], 0] = past[c, live] << scan.low


def _dc_refine(lanes: _Lanes, scan: Scan, out: np.ndarray) -> None:
    lane = np.repeat(np.arange(len(lanes.count)), lanes.count)
    inside = np.arange(len(lane)) - np.repeat(np.cumsum(lanes.count) - lanes.count, lanes.count)
    at = lanes.at[lane] + inside
    bit = (_peek(lanes, at) >> _U(63)).astype(np.int64)
    out[lanes.blocks[lanes.first[lane] + inside], 0] |= bit << scan.low


def _ac_first_scan(lanes: _Lanes, scan: Scan, out: np.ndarray) -> None:
    flat, lookup = out.reshape(-1), scan.ac.lookup  # type: ignore[union-attr]
    lo, hi = scan.band
    at, block, left = lanes.at.copy(), lanes.first.copy(), lanes.count.copy()
    k = np.full(len(at), lo)
    while len(at):
        word = _peek(lanes, at)
        found = lookup[(word >> _U(48)).astype(np.int64)]
        bits, symbol = found >> 8, found & 255
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        extra = np.where(ends, run, size)
        raw = ((word << bits.astype(_U)) >> _U(1) >> (63 - extra).astype(_U)).astype(np.int64)
        at += bits + extra
        k = np.where(ends, 64, k + run)
        put = np.flatnonzero((size > 0) & (k <= hi))
        flat[lanes.blocks[block[put]] * 64 + k[put]] = _extended(raw[put], size[put]) << scan.low
        k += 1
        over = np.flatnonzero(k > hi)
        if len(over):
            skip = np.where(ends[over], (1 << run[over]) + raw[over], 1)
            block[over] += skip
            left[over] -= skip
            k[over] = lo
            if (left[over] <= 0).any() or (found == 0).any():
                live = (left > 0) & (found > 0)
                at, block, left, k = at[live], block[live], left[live], k[live]
        elif not found.all():
            live = found > 0
            at, block, left, k = at[live], block[live], left[live], k[live]


def _refine_block(lanes: _Lanes, scan: Scan, flat: np.ndarray, base: np.ndarray, at: np.ndarray, run: np.ndarray, value: np.ndarray, band: np.ndarray) -> None:
    """A block of some lanes whose first symbol was read, a coefficient a step; positions and runs are updated."""
    lo, hi = scan.band
    one = 1 << scan.low
    for k in range(lo, hi + 1):
        need = np.flatnonzero((run < 0) & (band == 0))
        if len(need):
            _refine_symbol(lanes, scan, at, run, value, band, need)
        place = base + k
        now = flat[place]
        old = now != 0
        fix = np.flatnonzero(old)
        bit = (_peek(lanes, at[fix]) >> _U(63)).astype(np.int64)
        flat[place[fix]] += np.where(bit > 0, np.where(now[fix] > 0, one, -one), 0).astype(flat.dtype)
        at[fix] += 1
        passed = ~old & (band == 0)
        hit = np.flatnonzero(passed & (run == 0))
        flat[place[hit]] = value[hit]
        run -= passed


def _refine_symbol(lanes: _Lanes, scan: Scan, at: np.ndarray, run: np.ndarray, value: np.ndarray, band: np.ndarray, need: np.ndarray) -> None:
    one = 1 << scan.low
    word = _peek(lanes, at[need])
    found = scan.ac.lookup[(word >> _U(48)).astype(np.int64)]  # type: ignore[union-attr]
    bits, symbol = found >> 8, found & 255
    r, size = symbol >> 4, symbol & 15
    ends = (size == 0) & (r < 15)
    extra = np.where(ends, r, size)
    raw = ((word << bits.astype(_U)) >> _U(1) >> (63 - extra).astype(_U)).astype(np.int64)
    at[need] += bits + extra
    band[need] = np.where(ends, (1 << r) + raw, 0)
    run[need] = np.where(ends, -1, r)
    value[need] = np.where(size > 0, np.where(raw > 0, one, -one), 0)
    band[need[found == 0]] = 1 << 40  # no such code: the rest of the lane stays as it is


def _ac_refine_scan(lanes: _Lanes, scan: Scan, out: np.ndarray) -> None:
    """A block of each lane a step; where its band has ended, all its corrections at once."""
    flat = out.reshape(-1)
    lo, hi = scan.band
    one = 1 << scan.low
    n = len(lanes.at)
    at, band = lanes.at.copy(), np.zeros(n, np.int64)  # blocks of the end-of-band run, this one included
    for t in range(int(lanes.count.max())):
        live = np.flatnonzero(lanes.count > t)
        block = lanes.blocks[lanes.first[live] + t]
        run, value = np.full(len(live), -1), np.zeros(len(live), np.int64)
        own_at, own_band = at[live], band[live]
        need = np.flatnonzero(own_band == 0)
        if len(need):
            _refine_symbol(lanes, scan, own_at, run, value, own_band, need)
        done = np.flatnonzero(own_band > 0)
        if len(done):
            rows = block[done]
            now = out[rows, lo : hi + 1]
            old = now != 0
            number = np.cumsum(old, 1) - 1
            head, tail = _peek(lanes, own_at[done]) >> _U(32), _peek(lanes, own_at[done] + 32) >> _U(32)
            if old.all():
                both = np.concatenate([head.astype(">u4").view(np.uint8).reshape(-1, 4), tail.astype(">u4").view(np.uint8).reshape(-1, 4)], 1)
                bit = np.unpackbits(both, axis=1)[:, : hi - lo + 1]
            else:
                word = np.where(number < 32, head[:, None], tail[:, None])
                bit = ((word >> (31 - (number & 31)).astype(_U)) & _U(1)).astype(np.uint8) & old
            out[rows, lo : hi + 1] = now + np.where(now > 0, one, -one) * bit
            own_at[done] += number[:, -1] + 1
        slow = np.flatnonzero(own_band == 0)
        if len(slow):
            parts = [own_at[slow], run[slow], value[slow], own_band[slow]]
            _refine_block(lanes, scan, flat, block[slow] * 64, *parts)
            own_at[slow], own_band[slow] = parts[0], parts[3]
        at[live], band[live] = own_at, np.maximum(own_band - 1, 0)


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Accumulated coefficients of each image: blocks x 64 in zigzag order."""
    sizes = [im.frame.blocks() for im in images]
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros((int(bases[-1]), 64), np.int32)
    rounds: dict[tuple, list[tuple[Scan, Frame, int]]] = {}
    seen: dict[tuple, int] = {}
    for i, im in enumerate(images):
        for number, s in enumerate(im.scans):
            # scans of one kind that no image needs in another order go together
            kind = (s.band, s.high, s.low, None if s.ac is None else id(s.ac), tuple(id(d) for d in s.dc) if s.band[0] == 0 else 0, tuple(im.frame.sampling[c] for c in s.components) if s.band[0] == 0 else 0)
            key = (i, s.components, kind)
            seen[key] = seen.get(key, 0) + 1
            rounds.setdefault((s.high > 0, -s.low, seen[key], kind), []).append((s, im.frame, int(bases[i])))
    # first scans before refinements, coarse bits before fine ones
    for (refine, _, _, _), group in sorted(rounds.items(), key=lambda x: x[0][:3]):
        lanes, scan, frame = _lanes(group), group[0][0], group[0][1]
        if scan.band[0] == 0:
            _dc_refine(lanes, scan, out) if refine else _dc_first(lanes, scan, frame, out)
        else:
            (_ac_refine_scan if refine else _ac_first_scan)(lanes, scan, out)
    return [out[a:b] for a, b in zip(bases[:-1], bases[1:])]


@lru_cache(1)
def _transform() -> np.ndarray:
    """Inverse transform of a block in zigzag order, as integers times 2**12: sums stay exact in doubles."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))
    return np.rint(np.kron(basis, basis)[ZIGZAG] * 4096)


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8 x 8 samples of each block."""
    total = (blocks * quant).astype(np.float64) @ _transform()
    return np.clip((total.astype(np.int64) + 2048 >> 12) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb(frame: Frame, pixels: np.ndarray) -> np.ndarray:
    """The full-resolution tensor, height x width x 3, of an image's sample blocks."""
    across, down = max(h for h, _ in frame.sampling), max(v for _, v in frame.sampling)
    planes, at = [], 0
    for c, (h, v) in enumerate(frame.sampling):
        w, n = frame.grid(c)
        plane = pixels[at : at + w * n].reshape(n, w, 8, 8).transpose(0, 2, 1, 3).reshape(n * 8, w * 8)
        at += w * n
        if (h, v) != (across, down):
            plane = plane.repeat(down // v, 0).repeat(across // h, 1)
        planes.append(plane[: frame.height, : frame.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    out[:, :, 0] = np.clip(y + (91881 * r + 32768 >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - (22554 * b + 46802 * r + 32768 >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + (116130 * b + 32768 >> 16), 0, 255)
    return out


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of a batch of files."""
    images = [parse(f) for f in files]
    return [tensor(im, c) for im, c in zip(images, coefficients(images))]


def tensor(image: Image, blocks: np.ndarray) -> np.ndarray:
    sizes = [int(np.prod(image.frame.grid(c))) for c in range(len(image.frame.ids))]
    parts = np.split(blocks, np.cumsum(sizes)[:-1])
    return rgb(image.frame, np.concatenate([samples(p, image.quant[q]) for p, q in zip(parts, image.frame.quant)]))
