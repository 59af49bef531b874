import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm import edges
from trigrove.llm import _text as X
from trigrove.llm import maxent as M


def words(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split() + [None]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    got = M.lm_scores(docs).collect()
    want = Counter((r["doc_id"], held(r["doc_id"]), len(w := words(r["text"])), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for r in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 or (n == 0 and r["score"] <= 0) for r in got)
    return got


def test_edges(spark):
    assert len(check(spark, edges.frame(spark))) == len(edges.rows())
    check(spark, edges.frame(spark, [r for r in edges.rows() if r[0] is None]))  # nothing to learn from
    assert M.lm_scores(edges.empty(spark)).count() == 0


def test_words_beyond_the_top_are_joined(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP", 40)
    check(spark, edges.frame(spark))


def test_shares_add_up_to_one(spark):
    """Over the vocabulary and the other words' forms in any history, and over the words of a form."""
    docs = spark.createDataFrame([(i, f"the cat w{i % 5} sat on w{i % 11} the mat") for i in range(60)], "doc_id long, text string")
    counts = M.word_counts(docs)
    model = M.fit(docs, counts)
    assert np.abs(model.rows).max() > 0
    vocab = int((model.rank >= 0).sum())
    part = next(iter(X.texts(pa.array(["the cat sat on"]))))
    key, _, bounds = M.tokens(part)
    _, rank = model.ids(key)
    for feature in M.history(key, rank, bounds, model.others).T:
        tries = np.append(np.arange(vocab), np.full(M.FORMS, -1))
        form = np.append(np.zeros(vocab, np.int64), np.arange(M.FORMS))
        total = np.exp(M.log_probabilities(model, np.repeat(feature[:, None], len(tries), 1), model.leaves(tries, form))).sum()
        assert abs(total - 1) < 1e-4
    rest = [r for r in counts.collect() if np.int64(r["w"]).view(np.uint64) not in set(model.top[model.rank >= 0].tolist())]
    for f in range(M.FORMS):
        assert sum(r["n"] + 1 for r in rest if r["form"] == f) + 1 == model.other_size[f]


def test_history():
    key, _, bounds = M.tokens(next(iter(X.texts(pa.array(["a b c", "", "d"])))))
    assert bounds.tolist() == [0, 4, 5, 7]
    rank = np.arange(len(key))
    f = M.history(key, rank, bounds)
    assert all(x[0] == x[4] == x[5] for x in f) and all(len(set(x[:4].tolist())) == 4 for x in f)
    g = M.history(key, np.where(rank == 1, 1, 10**6 + rank), bounds)  # only the second token is very frequent
    assert g[1][0] == g[1][1] == g[1][4] == g[1][6] != g[1][2] == g[1][3]


def test_model_beats_the_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.lm_scores(docs).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert got["s"] > got["b"]


def test_changes_add_up_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 3)
    rows = [(slot, part, np.full(2, part, "<f8").tobytes(), np.full(4, slot, "<f4").tobytes()) for part in range(11) for slot in (0, 5) if (part + slot) % 4]
    sent = spark.createDataFrame([(s, p, bytearray(u), bytearray(t)) for s, p, u, t in rows], M._BLOCKS).repartition(11, "part")
    got = {r["slot"]: (np.frombuffer(r["used"], "<f8")[0], np.frombuffer(r["total"], "<f4")[0]) for r in M._summed(sent, 11).collect()}
    assert got == {s: (sum(p for t, p, _, _ in rows if t == s), s * sum(t == s for t, _, _, _ in rows)) for s in (0, 5)}


def test_the_model_grows_with_the_corpus():
    """Words, rows and depths follow the tokens, and each word has a path of its own."""
    assert M.sizes(0) == (M.VOCAB, M.ROWS)
    (small, few), (large, many) = M.sizes(10**8), M.sizes(10**10)
    assert large > 9 * small > 9 * M.VOCAB and many > 9 * few > 9 * M.ROWS and few % M._BLOCK == many % M._BLOCK == 0
    r = np.random.default_rng(1)
    for leaves in (1, 5, 600, 20_000):
        for mass in (np.ones(leaves), 1e9 / np.arange(1, leaves + 1), np.append(np.ones(leaves - 1), 1e12), r.permutation(1e9 / np.arange(1, leaves + 1) ** 2)):
            t = M.tree(mass)
            paths = {tuple((int(t.node[k, i]), int(t.child[k, i])) for k in range(t.depth[i])) for i in range(leaves)}
            assert len(paths) == leaves and t.child.max() < M.BRANCH and len(t.node) < 24
            assert np.allclose(np.exp(t.bias.astype(float)).sum(1), 1, atol=1e-4)


def test_history_predicts_words_beyond_the_512_most_frequent(spark):
    follows = [(7 * i + 3) % 1500 for i in range(1500)]

    def text(i):
        out, at = [], i * 37 % 1500
        for _ in range(2500):
            out.append(f"w{at}")
            at = follows[at] if len(out) % 50 else (at + i) % 1500
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(i)) for i in range(90)], "doc_id long, text string")
    counts = M.word_counts(docs)
    model = M.fit(docs, counts)
    assert (model.rank >= 512).sum() > 900
    part = next(iter(X.texts(pa.array(["w1 w2"]))))
    key, _, bounds = M.tokens(part)
    feature = M.history(key, model.ids(key)[1], bounds, model.others)[:, 1:2]
    tries = np.append(np.arange((model.rank >= 0).sum()), np.full(M.FORMS, -1))
    form = np.append(np.zeros(len(tries) - M.FORMS, np.int64), np.arange(M.FORMS))
    assert abs(np.exp(M.log_probabilities(model, np.repeat(feature, len(tries), 1), model.leaves(tries, form))).sum() - 1) < 1e-3
    got = M.score(docs, model, counts, keep=["doc_id"]).selectExpr("sum(score - base_score) / sum(n_tokens) as gain").first()["gain"]
    assert got > 0.5


def test_score_matches_a_plain_computation(spark):
    """Token by token, in Python: the softmaxes along a word's path from the fitted rows, and the unigram share of other words."""
    docs = spark.createDataFrame([(i, f"The cat w{i % 5} sat on w{i % 11} the mat, rare{i} ünï{i}") for i in range(40)], "doc_id long, text string")
    training = docs.where(~M.held_out("doc_id"))
    counts = M.word_counts(training)
    model = M.fit(training, counts)
    got = {r["doc_id"]: r["score"] for r in M.score(docs, model, counts, keep=["doc_id"]).collect()}
    n_of = {np.int64(r["w"]).view(np.uint64).item(): r["n"] for r in counts.collect()}
    mix = lambda v: int(M.X.mix(np.array([v % 2**64], np.uint64))[0])
    gold, t = int(M._GOLD), model.tree
    rank_of = {int(k): int(r) for k, r in zip(model.top, model.rank)}
    for i, text in [(r["doc_id"], r["text"]) for r in docs.limit(12).collect()]:
        key, form, _ = M.tokens(next(iter(X.texts(pa.array([text])))))
        own = [rank_of[k] + 1 if rank_of.get(k, -1) >= 0 else (1 << 40) + k % model.others + 1 for k in key.tolist()]
        total = 0.0
        for at, k in enumerate(key.tolist()):
            rank = rank_of.get(k, -1)
            a, b = ([0, 0] + own)[at + 1], ([0, 0] + own)[at]
            c = next((own[j] for j in reversed(range(at)) if 0 <= rank_of.get(key.tolist()[j], -1) < M.ANCHORS), 0)
            features = [mix(3 * a + 1), mix(5 * c + 4), mix(a * gold + 3 * b)]
            leaf = int(model.leaf[rank]) if rank >= 0 else len(model.leaf) + int(form[at])
            for level in range(t.depth[leaf]):
                node = int(t.node[level, leaf])
                z = t.bias[node].astype(float) + sum(model.rows[(mix(f + (node + 1) * gold) >> 32) * len(model.rows) >> 32].astype(float) for f in (features if level < M.UPPER else features[: M.LOWER_FEATURES]))
                total += (z[t.child[level, leaf]] - math.log(np.exp(z).sum())) / math.log(10)
            if rank < 0:
                total += math.log10(n_of.get(k, 0) + 1) - math.log10(model.other_size[form[at]])
        assert abs(total - got[i]) < 1e-3


def test_words_of_like_neighbourhoods_stand_together():
    r = np.random.default_rng(4)
    side = r.permutation(400) % 2
    near = r.poisson(np.where(side[:, None] == (np.arange(M.MARKERS) % 2)[None], 8.0, 0.2)).astype(np.float32)
    order = M.word_order(near, np.full(400, 10))
    assert (np.diff(side[order]) != 0).sum() == 1
    assert M.word_order(np.zeros((0, M.MARKERS), np.float32), np.zeros(0, np.int64)).size == 0


def test_words_are_looked_up_as_by_search():
    """The index of the top words finds what a binary search finds, also with crowded first bits and at both ends."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000, 4096):
        crowded = rng.integers(0, 1 << 20, n // 2, dtype=np.uint64)
        top = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), crowded, np.array([0, (1 << 64) - 1], np.uint64)]))
        rank = rng.permutation(len(top)) - 5
        m = M.Model(top, np.ones(len(top), np.int64), rank, 0, 0, np.ones(1), np.zeros(0), None, None, M.starts_of(top))
        key = np.concatenate([top, top + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
        at = np.minimum(np.searchsorted(top, key), len(top) - 1)
        at = np.where(top[at] == key, at, -1)
        got = m.ids(key)
        assert (got[0] == at).all() and (got[1] == np.where(at >= 0, rank[at], -1)).all()
