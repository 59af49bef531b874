"""Work and memory that grow no faster than the input; results across the bounds of lists, batches and pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from trigrove.functions import codecs, scan
from trigrove.operators import fields, index, positions, search
from trigrove.plans import catalog
from trigrove.sources.segments import SegmentReader, SegmentWriter


def shuffled(spark):
    """Bytes written to shuffles by this application so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def words(n, seed=0, alphabet="abcdefghijklmnopqrstuvwxyz"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 9))) for _ in range(n))


def prose(n, seed):
    """Lines of words that come again, as they do in real texts."""
    r = random.Random(seed)
    return "\n".join(" ".join(r.choices(VOCABULARY, k=20)) for _ in range(n // 20))


VOCABULARY = words(300).split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_codes_of_a_list_in_parts(spark, tmp_path):
    """a list longer than a part is still one row, coded from end to end."""
    rows = spark.range(66_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("s").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.posting_codecs(spark, str(tmp_path)).where("tri = '616263'").collect()
    assert [tuple(r) for r in got] == [("616263", 66_001, True)]
    folder = documents(spark, tmp_path / "b", [(i * i * 40, words(3, i, "abc"), "s") for i in range(120)])
    for most in (1, 7, 1 << 16):
        assert_same(catalog.posting_codecs(spark, folder, most), folder, catalog.ORACLES["posting_codecs"])


def test_many_varints():
    numbers = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 2**35, 2**62, 5]
    data, sizes = codecs.varints(np.array(numbers))
    assert data.tobytes() == b"".join(map(codecs.varint, numbers)) and sizes.tolist() == [codecs.varint_size(n) for n in numbers]
    assert codecs.read_varints(data).tolist() == numbers and not len(codecs.varints(np.zeros(0, np.int64))[0])


IDS = [5, 5, None, -1, -70_000, 1 << 40, 65_535, 65_536, 0, 9, 9, 7]


def test_stored_positions_are_all_there(spark, tmp_path):
    """repeated, missing and negative ids, characters of all lengths, and texts longer than a piece."""
    texts = ["aé字 abab", "abab", "ab ab", "x😀abab", "é" * 40, words(80_000, 1, "abé字"), "", "ab", words(30, 2), "same same", "same", None]
    docs = spark.createDataFrame([(i, f"n{k}", t) for k, (i, t) in enumerate(zip(IDS, texts))], "file_id long, name string, content string").repartition(3)
    want = {}
    for k, (i, t) in enumerate(zip(IDS, texts)):
        if t is not None:
            data = f"n{k}\n{t}".encode()
            rune = -1
            for at in range(len(data) - 2):
                rune += data[at] & 0xC0 != 0x80
                want.setdefault((data[at : at + 3].hex().upper(), i), []).append((at, rune))
    ix = positions.PositionalIndex.build(docs).write(f"file://{tmp_path}/p")
    got = {(r["tri"], r["file_id"]): [tuple(p) for p in r["positions"]] for r in ix.postings.collect()}
    assert got.keys() == want.keys() and all(got[k] == sorted(want[k]) for k in want)
    assert ix.postings.count() == len(want) and {r["tri"]: r["positions"] for r in ix.counts().collect()}["616261"] == sum(len(v) for (t, _), v in want.items() if t == "616261")


def test_positions_are_not_shuffled(spark, tmp_path):
    """a position took some 40 bytes of shuffle; lists aren't shuffled at all."""
    texts = [prose(400, k) for k in range(200)]
    docs = spark.createDataFrame([(k, "n", t) for k, t in enumerate(texts)], "file_id long, name string, content string")
    before = shuffled(spark)
    positions.PositionalIndex.build(docs).write(f"file://{tmp_path}/p")
    assert shuffled(spark) - before < sum(map(len, texts))


def test_postings_are_shuffled_as_lists(spark, tmp_path):
    """F3 and the other writes of postings: a posting took some 12 bytes of shuffle."""
    texts = [prose(400, k) for k in range(200)]
    docs = spark.createDataFrame([(k, "n", t) for k, t in enumerate(texts)], "file_id long, name string, content string")
    ix = index.TrigramIndex.build(docs)
    n = ix.postings.count()
    before = shuffled(spark)
    ix.write(f"file://{tmp_path}/i")
    assert shuffled(spark) - before < 4 * n + sum(map(len, texts))


def test_stored_postings_are_all_there(spark, tmp_path):
    """Repeated, missing and negative ids; postings of a stored index are those of the texts, sorted in ranges."""
    texts = ["abab", "abab", "ab ab", "xabab", "é" * 40, words(900, 1), "", "ab", words(30, 2), "same same", "same", None]
    docs = spark.createDataFrame([(i, f"n{k}", t) for k, (i, t) in enumerate(zip(IDS, texts))], "file_id long, name string, content string").repartition(3)
    ix = index.TrigramIndex.build(docs)
    stored = ix.write(f"file://{tmp_path}/i")
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    assert sorted(map(tuple, stored.postings.collect()), key=key) == sorted(map(tuple, ix.postings.collect()), key=key)
    for rows in stored.postings.rdd.glom().collect():
        assert [key(r) for r in rows] == sorted(key(r) for r in rows)
    for some in (ix, stored):
        lists = {}
        for r in some.lists(2).orderBy("part").collect():
            lists.setdefault(r["tri"], []).append(r["file_ids"])
        assert all(len(x) == 2 for v in lists.values() for x in v[:-1]) and all(0 < len(v[-1]) <= 2 for v in lists.values())
        want = {}
        for t, i in ix.postings.where("file_id is not null").collect():
            want.setdefault(t, []).append(i)
        assert {t: sum(v, []) for t, v in lists.items()} == {t: sorted(v) for t, v in want.items()}


def test_stored_fields(spark, tmp_path):
    rows = [(k % 9, f"d{k % 9}", f, words(20, k, "abcde")) for k in range(40) for f in ("t", "u", "other")] + [(3, "d3", "t", None)]
    ix = fields.FieldIndex.build(spark.createDataFrame(rows, "file_id int, name string, field string, content string"), ["t", "u"])
    stored = ix.write(f"file://{tmp_path}/f")
    assert dict(stored.postings.dtypes) == dict(ix.postings.dtypes) and sorted(stored.postings.columns) == sorted(ix.postings.columns)
    assert sorted(map(tuple, stored.postings.select("tri", "field_id", "file_id").collect())) == sorted(map(tuple, ix.postings.select("tri", "field_id", "file_id").collect()))


@pytest.mark.parametrize("query", ["abc", "é字", "é字 abcdef"])
def test_searches_of_texts_look_for_their_trigrams_only(spark, query):
    """nothing of the texts goes through Python workers, and the hits are those of all postings."""
    rows = [(k, f"n{k}é", words(30, k, "abcdé字")) for k in range(60)] + [(60, "z", "a\0abc"), (61, "l", "x" * 2001 + " abc"), (62, "null", None)]
    ix = index.TrigramIndex.build(spark.createDataFrame(rows, "file_id long, name string, content string"))
    tris = [query.encode()[i : i + 3].hex().upper() for i in range(len(query.encode()) - 2)]
    got = search.hits_of(ix, tris)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ix.postings.where(F.col("tri").isin(tris)).collect()))
    assert "MapInArrow" not in plan(got) and "MapInArrow" not in plan(ix.docs)


def test_texts_with_too_many_trigrams_are_left_out(spark):
    """A text long enough for that is counted by a worker."""
    r = random.Random(5)
    many = "\n".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(60))
    rows = [(0, "a", many), (1, "b", "plain text\n" * 5000), (2, "c", "short")]
    ix = index.TrigramIndex.build(spark.createDataFrame(rows, "file_id long, name string, content string"))
    assert sorted(r["file_id"] for r in ix.docs.collect()) == [1, 2]
    assert {r["file_id"] for r in ix.postings.collect()} == {1, 2} == {r["file_id"] for r in search.hits_of(ix, [b"tex".hex().upper(), many.encode()[:3].hex().upper(), b"sho".hex().upper()]).collect()}


def test_only_asked_positions_leave_a_worker(spark):
    """of two trigrams' positions all others were sent on."""
    docs = spark.createDataFrame([(k, "n", words(60, k, "ionwté ")) for k in range(20)], "file_id long, name string, content string")
    asked = ["696F6E", "776974"]
    got = positions.positions(docs, tris=asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, positions.positions(docs).where(F.col("tri").isin(asked)).collect()))
    assert "Filter tri" not in plan(got)


def test_workers_get_batches_of_bounded_size(spark):
    """whatever the table's size."""
    docs = spark.range(3000).select(F.col("id").alias("file_id"), F.lit("n").alias("name"), F.repeat(F.lit("some text "), 300).alias("content")).coalesce(1)
    index.TrigramIndex.build(docs)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * scan.BATCH_BYTES


def test_segments_are_shuffled_as_lists(spark, tmp_path):
    """F3, F4, F8, F9, F12: what a commit and a merge shuffle is a few times the texts; postings come out the same."""
    texts = [prose(400, k) for k in range(120)]
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    before = shuffled(spark)
    for half in (0, 1):
        w.apply(spark.createDataFrame([(f"p{k:03}", t) for k, t in enumerate(texts) if k % 2 == half], "path string, content string"))
    meta = SegmentReader.open(spark, w.path).meta
    w.merge([s["id"] for s in meta["segments"]])
    spent = shuffled(spark) - before
    reader = SegmentReader.open(spark, w.path)
    want = {(f"p{k:03}\n{t}".encode()[i : i + 3].hex().upper(), k) for k, t in enumerate(texts) for i in range(len(t) + 3)}
    got = [(r["tri"], r["local_id"]) for r in reader.postings().collect()]
    assert len(got) == len(want) and set(got) == want
    assert spent < 5 * sum(map(len, texts))


def test_positions_by_row_and_ids_that_are_no_numbers(spark, tmp_path):
    """Compat mode and text ids keep the format with a row for each trigram and document, and lists by rank."""
    docs = spark.createDataFrame([("x", "n", "abab é ab"), ("y", "m", "ab ab")], "file_id string, name string, content string")
    for name, made in (("c", positions.PositionalIndex.build(docs, compat=True)), ("t", positions.PositionalIndex.build(docs))):
        ix = made.write(f"file://{tmp_path}/{name}")
        assert sorted(map(repr, ix.postings.collect())) == sorted(map(repr, made.postings.collect())) and ix.table is None
        assert ix.counts().where("tri = '616220'").count() == 1
    stored = index.TrigramIndex.build(docs).write(f"file://{tmp_path}/i")
    assert {r["tri"]: r["file_ids"] for r in stored.lists().collect()}["626162"] == ["x"]
    numbered = spark.createDataFrame([(7, "n", "abab é ab"), (8, "m", "ab ab")], "file_id int, name string, content string")
    ix = positions.PositionalIndex.build(numbered).write(f"file://{tmp_path}/p")
    assert dict(ix.postings.dtypes)["file_id"] == "int" and sorted(r["file_id"] for r in ix.lookup("616220").collect()) == [7, 8]
    assert "PushedFilters: [In(tri" in plan(ix.lookup("616220")) or "EqualTo(tri" in plan(ix.lookup("616220"))
