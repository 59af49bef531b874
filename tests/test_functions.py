import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trigrove.functions import codecs, names, patterns
from trigrove.functions import trigrams as T


@given(st.integers(0, 2**64))
def test_varints(n):
    data = codecs.varint(n)
    assert codecs.read_varint(data) == (n, len(data))
    assert codecs.varint_size(n) == len(data)


@given(st.sets(st.integers(0, 2**32)))
def test_postings(ids):
    assert codecs.decode_postings(codecs.encode_postings(ids)) == sorted(ids)


def test_bitmap():
    b = codecs.Bitmap(100)
    for i in (0, 50, 99):
        b.delete(i)
    again = codecs.Bitmap.from_bytes(b.to_bytes())
    assert len(again) == 3 and 50 in again and 51 not in again and 100 in again


@given(st.text(alphabet="abé字\n", max_size=12))
@settings(max_examples=40)
def test_query_trigrams(text):
    raw = text.encode()
    assert T.of_query(text) == list(dict.fromkeys(raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)))


def test_query_rules():
    assert T.of_query("ab") == [] and T.of_query("ab\0cd") == []
    with pytest.raises(ValueError):
        T.of_query("a" * 2001)


def test_trigram_columns(spark):
    texts = ["abcd", "ab", "", "a字b", "aaaa", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.distinct_trigrams(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else T.of_query(t))
    assert spark.range(1).select(T.unpack(T.pack(F.lit("0A0B0C")))).first()[0] == "0A0B0C"


def test_admission(spark):
    cases = [("a" * 2000, True), ("a" * 2001, False), ("a" * 1999 + "\n", True), ("a" * 2000 + "\n", False), ("a\0b", False), ("", True), ("x\n" + "é" * 1000, True), ("x\n" + "é" * 1001, False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert {r.i: r.ok for r in df.select("i", T.admitted(F.col("t")).alias("ok")).collect()} == {i: ok for i, (_, ok) in enumerate(cases)}


def _pairs_ok(raw):
    def ok(a, b):
        if a < 0x80:
            return b < 0x80 or 0xC0 <= b < 0xF8
        if a < 0xC0:
            return b < 0xF8
        return a < 0xF8 and 0x80 <= b < 0xC0

    return all(ok(raw[i - 1], raw[i]) for i in range(2, len(raw)))


def test_binary_pairs(spark):
    import random

    r = random.Random(3)
    raws = [bytes(r.choice([0x41, 0x7F, 0x80, 0xBF, 0xC3, 0xE5, 0xF0, 0xF7, 0xF8, 0xFF]) for _ in range(r.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raws)], "i int, t binary")
    assert {r.i: r.ok for r in df.select("i", T.valid_pairs(F.col("t")).alias("ok")).collect()} == {i: _pairs_ok(x) for i, x in enumerate(raws)}


@pytest.mark.parametrize(("pattern", "n"), [("hello", 3), ("hel.o", 1), ("foo[0-9]+bar", 2), ("abc(def|ghi)jkl", 2), ("hello+world", 6), ("abc|xyz", 0), ("abcd?", 1), (r"foo\.bar", 2), ("a{3}bcd", 1)])
def test_required_trigrams(pattern, n):
    assert len(patterns.required_trigrams(pattern)) == n


@given(st.text(alphabet="abc.?*+|()[]", max_size=10), st.text(alphabet="abc", max_size=12))
@settings(max_examples=300)
def test_required_trigrams_are_required(pattern, text):
    try:
        hit = re.search(pattern, text)
    except re.error:
        return
    if hit and not re.search(r"\[[^\]]*$", pattern):
        assert all(t in T.of_query(text) for t in patterns.required_trigrams(pattern))


def test_names(spark):
    for raw, want in (("Title Only Index", "title-only-index"), ("--A_b!", "a-b"), ("é", None), ("Xé1", "x--1")):
        if want is None:
            with pytest.raises(ValueError):
                names.sanitised(raw)
        else:
            assert names.sanitised(raw) == want
        assert spark.range(1).select(names.sanitised_column(F.lit(raw))).first()[0] == want
    assert len(names.segment_id()) == 32 and names.project_name("/a/b").startswith("b-")


def test_rune_samples(spark):
    for text, want in (("a" * 250, [0, 100, 200]), ("é" * 150, [0, 200]), ("", []), ("a" * 100, [0]), ("字\n" * 101, [0, 200, 400])):
        assert spark.range(1).select(T.rune_samples(F.lit(text))).first()[0] == want
    assert spark.range(1).select(T.rune_to_byte(F.lit("é字a"), F.lit(2))).first()[0] == 5
