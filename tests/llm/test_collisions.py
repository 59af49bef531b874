"""Texts that an algebraic hash confuses, and hashes that are made to meet: results follow the bytes."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from trigrove.llm import _text as X
from trigrove.llm import bpe, linededup, minhash, packing, quality
from trigrove.llm.queries import tokenizer_path


def thue_morse(n):
    """A word of a and b and its complement: equal under every polynomial modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


SIZES = [1024, 2048, 4096, 8192]


def test_hashes_differ():
    for n in SIZES:
        raw = "\n".join(thue_morse(n)).encode()
        data = np.frombuffer(raw, np.uint8)
        h = X.segment_hash(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert h[0] != h[1]
        assert (X.segment_hash(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]), seed=1) != h).all()


def pairs(spark):
    rows = [(2 * i + k, t) for i, n in enumerate(SIZES) for k, t in enumerate(thue_morse(n))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup(spark):
    rows, docs = pairs(spark)
    got = linededup.line_dedup(docs, min_words=1).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == set(rows) and all(r["n_removed"] == 0 for r in got)


def test_near_dedup(spark):
    rows, docs = pairs(spark)
    assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())


def test_bpe_and_packing(spark):
    import tiktoken
    from tokenizers import Tokenizer
    import public_tokenizers

    rows, docs = pairs(spark)
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Bpe.load(path).ranks, special_tokens={})
    for r in bpe.digests(docs, path).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pieces(docs, path).collect()} == sizes


def test_quality_statistics():
    a, b = thue_morse(2048)
    part = next(iter(X.texts(pa.array([f"{a}\n{b}\n{a}", f"{a} x y {b} x y"]))))
    found = quality.statistics(part, X.words(part))
    assert found["n_dup_lines"].tolist() == [1, 0] and found["n_repeat_words"].tolist() == [0, 0]


@pytest.fixture
def colliding(monkeypatch):
    """Every segment of one length has one hash."""
    monkeypatch.setattr(X, "segment_hash", lambda data, start, end, seed=0: (end - start).astype(np.uint64))


def test_encoder_when_hashes_meet(colliding):
    import tiktoken
    import public_tokenizers

    made = bpe.Bpe.load(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    texts = ["the cat and the dog", "dog the and cat", "", "one two"]
    for _ in range(2):  # the second time from the cache
        for part in X.texts(pa.array(texts)):
            ids, bounds = made.encoder.rows(part)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_quality_when_hashes_meet(colliding):
    part = next(iter(X.texts(pa.array(["a b c\nd e f\na b c", "a b c d e f"]))))
    found = quality.statistics(part, X.words(part))
    assert found["n_dup_lines"].tolist() == [1, 0] and found["n_repeat_words"].tolist() == [6, 0]


def test_exact_ids_when_hashes_meet(colliding):
    part = next(iter(X.texts(pa.array(["aa bb aa c bb"]))))
    w = X.words(part)
    ids, n = X.exact_ids(part.data, w.start, w.end)
    assert n == 3 and ids[0] == ids[2] and ids[1] == ids[4] and len(set(ids.tolist())) == 3
