import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import edges
from trigrove.llm import _text as X
from trigrove.llm import quality as Q


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


TEXTS = ["", None, "a", "a b c a b c", "x\nx\nx", "# $ é字 | <>", "a b\n\n \na b\n", "w " * 60, "\n", "a b c", "t\n" + "l m n o\n" * 3 + "l m"]


def test_statistics_match_brute_force():
    for part in X.texts(pa.array(TEXTS, pa.string()), 8):
        found = Q.statistics(part, X.words(part))
        for i in range(len(part.offsets) - 1):
            assert {k: v[i] for k, v in found.items()} == brute(TEXTS[part.first + i])


def test_edges(spark):
    model = Q.Model(np.zeros(Q.BUCKETS), 0.0)
    got = Q.quality_rules(edges.frame(spark), model)
    assert got.columns.count("kept") == 1 and "a.b" in got.columns
    for r in got.collect():
        want = brute(r["text"])
        assert {k: r[k] for k in want} == want and r["kept"] == (not want["base_failed"])
    assert Q.quality_rules(edges.empty(spark), model).count() == 0


def test_ratio_matches_brute_force(spark):
    docs = edges.frame(spark).where("doc_id is not null")
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 8, 1).otherwise(0).alias("quality"))
    model = Q.fit(docs, labels)
    counts = [Counter(), Counter()]
    for r in docs.collect():
        part = next(iter(X.texts(pa.array([r["text"] or ""]))))
        grams = Q.features(X.words(part))[0].tolist()
        counts[0].update(grams)
        if r["doc_id"] == 8:
            counts[1].update(grams)
    total, trusted = sum(counts[0].values()), sum(counts[1].values())
    for b in list(counts[0])[:200]:
        prior = (counts[0][b] + 1) / (total + Q.BUCKETS)
        assert math.isclose(model.ratio[b], math.log((counts[1][b] + Q.BUCKETS * prior) / (trusted + Q.BUCKETS) / prior), abs_tol=1e-9)


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(edges.frame(spark), labels)
    assert not model.ratio.any() and model.threshold == float("-inf")
    assert Q.fit(edges.empty(spark), labels).threshold == float("-inf")


def test_threshold():
    assert Q.fit_threshold(np.array([]), np.array([1.0])) == float("-inf")
    assert Q.fit_threshold(np.array([1.0, 2.0]), np.array([-1.0, 1.5])) == 0.0
    assert Q.fit_threshold(np.array([1.0]), np.array([])) < 1.0


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = Q.quality_rules(docs, Q.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where("not base_failed")
    rates = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.1


def test_every_labelled_row_counts(spark):
    """More trusted rows and more labelled rows of a class than fit any fixed sample."""
    words = "concat_ws(' ', transform(sequence(0, 54), j -> concat(if(id % 6 = 0 and j % 3 = 0, 'x', 'w'), pmod(xxhash64(id, j), 3000))))"
    docs = spark.range(25_000).selectExpr("id as doc_id", f"{words} as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 6 = 0, 0, 1) as quality")
    model = Q.fit(docs, labels)
    kept = docs.orderBy("doc_id").toPandas()
    good = (kept.doc_id % 6 != 0).to_numpy()
    assert good.sum() > 20_000 and (~good).sum() > 4_000
    parts = [(p, X.words(p)) for p in X.texts(pa.array(kept.text, pa.string()))]
    corpus, trusted = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for p, w in parts:
        bucket, row = Q.features(w)
        corpus += np.bincount(bucket, minlength=Q.BUCKETS)
        trusted += np.bincount(bucket[good[p.first + row]], minlength=Q.BUCKETS)
    prior = (corpus + 1) / (corpus.sum() + Q.BUCKETS)
    assert np.allclose(model.ratio, np.log((trusted + Q.BUCKETS * prior) / (trusted.sum() + Q.BUCKETS) / prior), atol=1e-9)
    score = np.concatenate([Q.scores(w, len(p.offsets) - 1, model.ratio) for p, w in parts])
    ok = ~np.concatenate([Q.statistics(p, w)["base_failed"] for p, w in parts])
    assert model.threshold == Q.fit_threshold(score[ok & good], score[ok & ~good])


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(5)
    for good, bad in (([], [1.0]), ([1.0, 2.0], [-1.0, 1.5]), ([1.0], []), ([0.0, 0.0], [-0.0, -3.0]), (rng.normal(size=1500).round(2), rng.normal(-2, 1, 300)), (-rng.random(1200), -rng.random(90))):
        good, bad = np.array(good, float), np.array(bad, float)
        rows = [(q, int(o)) for q, s in ((1, good), (0, bad)) for o in Q._ordered((s + 0.0).view(np.int64))]
        assert Q.threshold_of(spark.createDataFrame(rows, "q int, o long")) == Q.fit_threshold(good, bad)
