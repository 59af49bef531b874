import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from trigrove.llm import warc as W


def archive(n, seed=1):
    r = random.Random(seed)
    bodies, offsets, at = [], [], 0
    for i in range(n):
        payload = bytes(r.randrange(256) for _ in range(r.choice([0, 3, 50, 4000]))) + (W._MAGIC if i % 3 == 0 else b"")
        member = W._member(W.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None))
        bodies.append(member)
        offsets.append(at)
        at += len(member)
    return b"".join(bodies), offsets


@pytest.mark.parametrize("size", [1, 7, 100, 1000, 10**9])
def test_ranges_own_the_records_that_start_inside(size):
    data, offsets = archive(40 if size > 1 else 5)
    found = []
    for begin in range(0, len(data), size):
        own = [r["page_id"] for r in W.records_in(io.BytesIO(data), begin, min(begin + size, len(data)))]
        assert own == [i for i, o in enumerate(offsets) if begin <= o < begin + size]
        found += own
    assert found == list(range(len(offsets)))


def test_magic_inside_a_member_is_no_record():
    inner = gzip.compress(b"not a record " * 10, 0)
    body = W.record(1, "u", inner * 3, "0", None)
    stored = gzip.compress(body, 0)  # stored blocks show the inner members' magic
    data = stored + W._member(W.record(2, "u", b"x", "0", None))
    at = data.find(W._MAGIC, 5)
    assert 0 < at < len(stored)
    assert [r["page_id"] for r in W.records_in(io.BytesIO(data), 5, len(data))] == [2]


def test_damage_is_reported():
    data, offsets = archive(5)
    broken = data[: offsets[3] + 12] + b"\xff" * 9 + data[offsets[3] + 21 :]
    with pytest.raises(ValueError):
        list(W.records_in(io.BytesIO(broken), 0, len(broken)))


ROWS = [(0, "u0", "x" * 120), (1, "u1", "x" * 120), (2, None, None), (3, "u3", ""), (4, "u4", "y" * 99), (5, "u5", "y" * 99), (6, "u6", "é字" * 40), (1, "u1", "x" * 120), (0, "u0", "x" * 120), (None, "n", "x" * 120), (None, "n", "z" * 200), (7, "u\r\n7", "é字" * 40)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, n string, `path` int").repartition(3)
    got = W.read(spark, W.write(pages), split_bytes=200).collect()
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        same = [k for k, _, h in ROWS if (h or "") == (html or "") and k is not None]
        first = min(same) if len(raw) >= 100 and same else None
        revisit = first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read(spark, W.write(pages)).count() == 0


def test_only_reported_archives_are_read(spark):
    pages = spark.createDataFrame(ROWS[:5], "page_id long, url string, html string").repartition(2)
    done = W.write(pages)
    assert done.agg(F.sum("records")).first()[0] == 5
    assert W.read(spark, done.limit(1)).count() == done.limit(1).agg(F.sum("records")).first()[0]
