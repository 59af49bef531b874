import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import edges
from trigrove.llm import _text as X
from trigrove.llm import langid as L


def brute_phrases(train, symbols):
    """Greedy longest matches by substring search; an unseen symbol closes its phrase."""
    n = at = 0
    while at < len(symbols):
        size = 0
        while at + size < len(symbols) and symbols[at : at + size + 1] in train:
            size += 1
        if at + size < len(symbols) and symbols[at + size] not in train:
            size += 1
            if at + size == len(symbols):
                return n + 2  # the block ends in the phrase after it
        n += 1
        at += size
    return n


def coded(m, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    letters, bounds, _ = L.symbols_of(raw, np.array([0, len(raw)]))
    return L.as_bytes(letters, bounds)


def check(texts, samples):
    m = L.train(texts)
    for sample in samples:
        symbols, bounds = coded(m, sample)
        got = L.phrases(m, symbols, bounds)[0]
        for k, name in enumerate(m.names):
            train = "".join(chr(c) for c in m.code[coded(m, texts[name][0])[0]])
            assert got[k] == brute_phrases(train, "".join(chr(c) for c in m.code[symbols])), (sample, name)


def test_phrases_match_brute_force():
    check({"aa": ["abracadabra banana bandana"], "bb": ["xylophone zebra oxen lynx"]}, ["banana split abra", "zebra zebra lynx", "q", "abra", "ßß ß", "字 banana字"])


def test_phrases_cross_the_blocks(monkeypatch):
    r = random.Random(2)
    texts = {"aa": ["".join(r.choices("ab ", k=60))], "bb": ["abba " * 12]}
    samples = ["".join(r.choices("abq ", weights=[8, 8, 1, 3], k=r.randint(0, 60))) for _ in range(60)] + ["abba " * 30, "ab" * 50]
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        check(texts, samples)
    m = L.train(texts)
    many = [coded(m, x) for x in samples]
    bounds = np.cumsum([0] + [len(x) for x, _ in many])
    got = L.phrases(m, np.concatenate([x for x, _ in many]), bounds)
    assert (got == np.concatenate([L.phrases(m, x, b) for x, b in many])).all()


def test_scripts_of_many_letters():
    """Thousands of different letters stay apart."""
    r = random.Random(5)
    one, two = ([chr(0x4E00 + k) for k in range(a, a + 2000)] for a in (0, 2000))
    m = L.train({"one": ["".join(r.choices(one, k=1500))], "two": ["".join(r.choices(two, k=1500))]})
    part = next(iter(X.texts(pa.array(["".join(r.choices(one, k=300)), "".join(r.choices(two, k=300))]))))
    assert [m.names[k] for k in L.predict(m, part)[0]] == ["one", "two"]


def test_training_texts_are_whole_and_bounded():
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(30_000))
    assert len(L._bounded(["ab cd"] * 3, 1000)) == 3 * len("ab cd")
    got = L._bounded([long, "ab cd"], 5000)
    assert len(got) <= 5000 and bytes(got[-500:]) in long.encode()


def test_symbols():
    part = next(iter(X.texts(pa.array(["Ab, c!", "", "1 2", "É"]))))
    symbols, bounds, known = L.symbols_of(part.data, part.offsets)
    assert ["".join(map(chr, symbols[a:b])) for a, b in zip(bounds, bounds[1:])] == ["ab c", "", "", "é"]
    assert known.tolist() == [True, False, False, True]


def test_edges(spark):
    docs = edges.frame(spark)
    model = L.fit(docs)
    assert model.names == ["en"]
    for r in L.identify(docs, model).collect():
        has_letter = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert r["lang_pred"] == ("en" if has_letter else "und") and 0 <= r["score"] <= 1
    none = L.fit(edges.empty(spark))
    assert {r["lang_pred"] for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(edges.empty(spark), model).count() == 0


def test_long_text_is_parsed_whole():
    m = L.train({"en": ["the cat sat on the mat"], "fr": ["le chat est sur la table"]})
    text = "the cat " * 3000 + "le chat est sur la table " * 3000
    pred, score, _ = L.predict(m, next(iter(X.texts(pa.array([text])))))
    assert m.names[pred[0]] == "fr" and 0 < score[0] < 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", L.held_out("doc_id"))
    got = L.identify(docs, L.fit(docs), keep=["lang", "held_out"]).where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
