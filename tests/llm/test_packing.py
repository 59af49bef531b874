import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tests.llm import edges
from trigrove.llm import packing as K
from trigrove.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_patterns_hold_every_length_once():
    r = random.Random(5)
    for limit, n in ((10, 50), (64, 1000), (1024, 20000), (7, 1)):
        lengths = Counter(r.randint(1, limit) for _ in range(n))
        found = K.patterns(dict(lengths), limit)
        placed = Counter()
        for p, count in found:
            assert sum(p) <= limit and count > 0
            for x in p:
                placed[x] += count
        assert placed == lengths
    assert K.patterns({}) == []
    full = K.patterns({1024: 5, 512: 4, 1: 3})
    assert sum(c for _, c in full) == 8
    # many rests fill their sequences almost wholly
    lengths = Counter(r.randint(1, 1024) for _ in range(50000))
    used = sum(c for _, c in K.patterns(dict(lengths)))
    assert used * 1024 * 0.98 < sum(k * c for k, c in lengths.items())


def verify(docs, found, limit):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in docs:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for a in range(0, len(ids), limit):
            part = ids[a : a + limit]
            want[r["doc_id"], a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit


def test_edges(spark):
    docs = edges.frame(spark)
    for limit in (16, 1024):
        verify(docs.collect(), K.pack(docs, PATH, limit).collect(), limit)
    assert K.pack(edges.empty(spark), PATH).count() == 0


def test_ranks_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_ROWS", 7)
    docs = spark.range(60).selectExpr("id as doc_id", "repeat('word ', cast(id % 9 as int)) as text").union(spark.sql("select 3L, 'word word word '"))
    verify(docs.collect(), K.pack(docs, PATH, 16).collect(), 16)
