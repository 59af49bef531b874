import hashlib
import zlib

import numpy as np

from tests.llm import edges
from trigrove.llm import jpeg as J
from trigrove.llm import media as M


def frames(r, sampling, n=3):
    ids = tuple(range(1, len(sampling) + 1))
    return [J.Frame(int(r.integers(1, 70)), int(r.integers(1, 50)), ids, sampling, (0,) * len(sampling)) for _ in range(n)]


def visible(frame):
    """Blocks that the scans of single components reach."""
    return np.concatenate([frame.order((c,)) for c in range(len(frame.ids))])


def test_coefficients_round_trip():
    r = np.random.default_rng(1)
    for trial in range(40):
        sampling = [((1, 1),), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1))][trial % 4]
        fs = frames(r, sampling)
        values = []
        for f in fs:
            top = int(r.choice([0, 1, 2, 3, 30, 1000]))
            v = r.integers(-top, top + 1, (f.blocks(), 64)) * (r.random((f.blocks(), 64)) < r.choice([0.02, 0.2, 1]))
            hidden = np.setdiff1d(np.arange(len(v)), visible(f))
            v[hidden, 1:] = 0  # padding blocks hold no more than their mean
            values.append(v)
        files = J.encode(fs, values, [b"note"] * len(fs))
        got = J.coefficients([J.parse(f) for f in files])
        assert all((a == b).all() for a, b in zip(values, got))
        one = J.coefficients([J.parse(files[0])])[0]
        assert (one == values[0]).all()
        assert J.decode(files)[0].shape == (fs[0].height, fs[0].width, 3)


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, value, size):
        self.bits += format(value, f"0{size}b") if size else ""

    def bytes(self):
        padded = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


def test_end_of_band_runs_without_restarts():
    """A grey file as other encoders write it: one run over many blocks, no restart markers, several tables."""
    dc, ac = J.standard()
    f = J.Frame(40, 24, (1,), ((1, 1),), (0,))  # 15 blocks
    values = np.zeros((15, 64), np.int64)
    values[:, 0] = np.arange(15) * 2
    values[4, 7] = 6
    values[9, 20] = -2
    first, band, dc_fix, ac_fix = Bits(), Bits(), Bits(), Bits()
    past = 0
    for v in values[:, 0] >> 1:
        s = int(J._category(np.array(v - past)))
        first.put(int(dc.code[s]), int(dc.size[s]))
        first.put(int(J._magnitude(np.array(v - past), s)), s)
        past = v
        dc_fix.put(0, 1)

    def run(out, blocks):
        n = blocks.bit_length() - 1
        out.put(int(ac.code[n << 4]), int(ac.size[n << 4]))
        out.put(blocks - (1 << n), n)

    run(band, 4)
    band.put(int(ac.code[6 << 4 | 2]), int(ac.size[6 << 4 | 2]))
    band.put(3, 2)
    run(band, 5)
    band.put(int(ac.code[0xF0]), int(ac.size[0xF0]))
    band.put(int(ac.code[3 << 4 | 1]), int(ac.size[3 << 4 | 1]))
    band.put(0, 1)
    run(band, 6)
    run(ac_fix, 15)
    ac_fix.put(0, 2)  # a correction bit for each of the two values
    scan = lambda lo, hi, a, bits: J._marker(0xDA, bytes((1, 1, 0, lo, hi, a))) + bits.bytes()
    data = (
        b"\xff\xd8" + J._marker(0xDB, b"\0" + b"\1" * 64) + J._marker(0xC4, b"\0" + dc.counts + dc.symbols + b"\x10" + ac.counts + ac.symbols)
        + J._marker(0xC2, b"\x08" + (24).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + scan(0, 0, 0x01, first) + scan(1, 63, 0x01, band) + scan(0, 0, 0x10, dc_fix) + scan(1, 63, 0x10, ac_fix) + b"\xff\xd9"
    )
    assert (J.coefficients([J.parse(data)])[0] == values).all() and J.decode([data])[0].shape == (24, 40, 3)
    assert f.blocks() == 15


def test_inverse_transform_and_colours():
    r = np.random.default_rng(2)
    blocks = r.integers(-60, 60, (20, 64))
    want = np.zeros((20, 8, 8))
    c = [np.sqrt(0.5)] + [1.0] * 7
    for k in range(64):
        u, v = divmod(int(J.ZIGZAG[k]), 8)
        wave = np.outer(np.cos((2 * np.arange(8) + 1) * u * np.pi / 16), np.cos((2 * np.arange(8) + 1) * v * np.pi / 16))
        want += blocks[:, k, None, None] * wave * c[u] * c[v] / 4
    got = J.samples(blocks, np.ones(64, np.int64)).astype(int)
    assert np.abs(got - np.clip(np.rint(want + 128), 0, 255)).max() <= 1
    f = J.Frame(16, 16, (1, 2, 3), ((2, 2), (1, 1), (1, 1)), (0, 0, 0))
    pixels = np.full((6, 8, 8), 128, np.uint8)
    pixels[:4], pixels[5] = 100, 228
    assert J.rgb(f, pixels)[3, 5].tolist() == [240, 29, 100]


def test_payloads():
    payloads = [bytes(64), bytes(range(256)), b"\x80" * 64, b"text" * 16 * 40, b"\xff\x00" * 32 * 7]
    files = M.stored(payloads)
    back, images = M.read_back(files)
    assert back == payloads and M.stored([payloads[3]])[0] == files[3]
    assert (M.read_back([files[3]])[1][0] == images[3]).all()


def test_edges(spark):
    docs = edges.frame(spark)
    got = M.digests(M.media_column(docs.select("doc_id", "text", "kept"), keep=["doc_id", "text", "kept"])).collect()
    assert len(got) == docs.count()
    seen = {}
    for r in got:
        raw = (r["text"] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert seen.setdefault(raw, (r["media_sha256"], r["feature"], r["media_bytes"])) == (r["media_sha256"], r["feature"], r["media_bytes"])
    assert M.digests(M.media_column(edges.empty(spark))).count() == 0


def test_tensors(spark):
    files = M.media_column(edges.frame(spark).where("doc_id in (0, 7)"), keep=["doc_id"])
    for r in M.rgb_tensors(files).collect():
        assert len(r["rgb"]) == 3 * r["height"] * r["width"] > 0
    assert M.rgb_tensors(files.selectExpr("doc_id", "cast(null as binary) as media")).where("rgb is not null").count() == 0
