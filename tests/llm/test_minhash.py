import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import edges
from trigrove.llm import _store
from trigrove.llm import _text as X
from trigrove.llm import minhash as M
from trigrove.llm.components import connected_components


def sets_of(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    """component of each id"""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_of(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s[0]) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, sizes = brute([r for r in rows if r[0] is not None])
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]])
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_groups_match_brute_force(spark):
    r = random.Random(4)
    rows, at = [], 0
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 8, 30, 120]))]
        for _ in range(r.choice([1, 2, 8])):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                text[r.randrange(len(text))] = f"x{r.randint(0, 999)}"
            rows.append((at, " ".join(text).upper() if r.random() < 0.3 else " ".join(text)))
            at += 1
            if r.random() < 0.2:
                base = text  # chains drift
    r.shuffle(rows)
    check(spark, rows)


def test_edges(spark):
    check(spark, [(r[0], r[1]) for r in edges.rows()])
    assert M.near_duplicates(edges.frame(spark)).count() == len(edges.rows())
    assert M.near_duplicates(edges.empty(spark)).count() == 0


def test_signatures_estimate_similarity():
    r = random.Random(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(6):
            n = 300
            common = [f"c{r.random()}" for _ in range(int(2 * n * share / (1 + share)))]
            texts = [" ".join(sorted(common) + [f"u{r.random()}" for _ in range(n - len(common))]) for _ in range(2)]
            value, bounds = M.shingle_sets(next(iter(X.texts(pa.array(texts)))))
            s = M.signatures(value, bounds)
            true = len(np.intersect1d(value[: bounds[1]], value[bounds[1] :])) / len(np.union1d(value[: bounds[1]], value[bounds[1] :]))
            errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.15


def test_early_stop_changes_nothing():
    """Against the plain definition: every shingle walks through all ranks."""
    slots = 16
    value, bounds = M.shingle_sets(next(iter(X.texts(pa.array(["a b c d e f g h", "q r", "a b a c a d a e a f a g"])))))
    got = M.signatures(value, bounds, slots)
    for row in range(3):
        best = [0xFFFFFFFF] * slots
        for v in value[bounds[row] : bounds[row + 1]]:
            perm = list(range(slots))
            for j in range(slots):
                draw = int(M.X.mix(np.array([(int(v) + (j + 1) * int(M._GOLD)) % 2**64], np.uint64))[0])
                k = j + ((draw >> 32) * (slots - j) >> 32)
                perm[j], perm[k] = perm[k], perm[j]
                best[perm[j]] = min(best[perm[j]], j << 24 | draw & 0xFFFFFF)
        assert got[row].tolist() == best


def test_components(spark):
    edges_ = [(i, i + 1) for i in range(0, 60)] + [(200, 300), (300, 100), (7, 7), (None, 3), (500, 400), (400, 500)]
    df = spark.createDataFrame(edges_, "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100, 500: 400}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_links_are_named_as_those_of_the_grouping(spark):
    """Of mutually similar texts only links that span the group are counted, and the column says so."""
    base = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(i, f"{base} end{i}") for i in range(6)], "doc_id long, text string")
    got = M.near_duplicates(docs)
    assert "n_links" not in got.columns
    rows = got.collect()
    assert {r["component_id"] for r in rows} == {0} and all(r["n_spanning_links"] >= 1 for r in rows)


def test_pages_of_one_template_meet_in_few_pairs(spark):
    """Seven tenths in common: they share buckets, but none is linked and few pairs are compared."""
    common = " ".join(f"t{k}" for k in range(140))
    rows = [(i, common + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(60)]
    rows += [(100, rows[7][1] + " more"), (101, rows[9][1] + " words")]
    check(spark, rows)
    part = next(iter(X.texts(pa.array([t for _, t in rows]))))
    value, bounds = M.shingle_sets(part)
    sets = [(i, i, value[bounds[k] : bounds[k + 1]].view(np.int64).tolist()) for k, (i, _) in enumerate(rows)]
    pairs = {(r["a"], r["b"]) for r in M._across(spark.createDataFrame(sets, "node long, c long, shingles array<long>")).collect()}
    assert {(7, 100), (9, 101)} <= pairs and len(pairs) < 20  # of 1,891


@pytest.mark.parametrize("dealt", [4096, 3])
def test_prefix_filter_misses_no_link(spark, monkeypatch, dealt):
    monkeypatch.setattr(M, "TOKEN_ROWS", dealt)
    r = random.Random(6)
    sets = []
    for i in range(120):
        base = r.sample(range(30), r.choice([1, 2, 4, 9, 20]))
        sets.append((i, i, sorted({x if r.random() < 0.9 else 100 + x for x in base})))
    got = {(x["a"], x["b"]) for x in M._across(spark.createDataFrame(sets, "node long, c long, shingles array<long>")).collect()}
    want = {(a, b) for a, _, x in sets for b, _, y in sets if a < b and 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))}
    assert want <= got


def test_tables_go_when_nothing_reads_them_any_more(spark, tmp_path, monkeypatch):
    """Signatures, sets and candidates don't stay on the disk beside the result, nor do shuffle files."""
    monkeypatch.setattr(_store, "shared_folder", lambda session: f"file://{tmp_path}")
    base = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(base[: 40 - i % 7] + [f"x{i % 5}"] * (i % 3))) for i in range(60)], "doc_id long, text string")
    found = M.near_duplicates(docs)
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} <= {"minhash-rows", "minhash-links", "cc"}
    got = {(r["doc_id"], r["component_id"]) for r in found.collect()}
    assert got == set(brute([(r["doc_id"], r["text"]) for r in docs.collect()])[0].items())
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    _store.written(docs.repartition(3, "doc_id"), "test")
    for _ in range(50):  # they are removed beside the run
        if files.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert files.getAllFiles().size() <= before


def test_sieve_loses_no_key(spark):
    keys = spark.range(0, 30_000, 7).select(F.col("id").alias("k"))
    rows = spark.range(-30_000, 60_000).select("id", F.lit("x").alias("text")).union(spark.createDataFrame([(None, "x")], "id long, text string"))
    left = _store.sieved(rows, F.col("id"), keys)
    assert left.columns == rows.columns
    got = [r["id"] for r in left.select("id").collect()]
    wanted = {r["k"] for r in keys.collect()}
    assert len(got) == len(set(got)) and wanted <= set(got) and len(got) < len(wanted) + 0.15 * 90_000
    assert _store.sieved(rows, F.col("id"), keys.limit(0)).isEmpty()
