import time

from pyspark.sql import functions as F

from trigrove.operators.index import global_ids
from trigrove.sources.files import FileTracker, changes
from trigrove.sources.manager import IndexManager
from trigrove.sources.segments import SegmentReader, SegmentWriter, live_docs, manifest, path_index, total_docs
from trigrove.streaming import changes as streaming

HEL = b"hel".hex()


def counts(spark, path):
    r = SegmentReader.open(spark, path)
    return r.segment_count, r.document_count, r.lookup(HEL).count()


def test_life_of_an_index(spark, tmp_path):
    path = f"file://{tmp_path}/seg"
    assert manifest(spark, path) == {"version": 1, "opstamp": 0, "segments": []}
    w = SegmentWriter(spark, path)
    w.add_file("hello.txt", "hello world")
    w.add_file("foo.txt", "hello there foo bar")
    w.commit()
    assert counts(spark, path) == (1, 2, 2)
    w.add_file("code.txt", "def hello(): pass")
    w.commit()
    assert counts(spark, path) == (2, 3, 3)
    w.delete_file("foo.txt")
    w.commit()
    assert counts(spark, path) == (2, 2, 2)
    w.add_file("hello.txt", "updated content")
    meta = w.commit()
    assert (w.segment_count, w.document_count) == (3, 2) and meta["opstamp"] == 4
    reader = SegmentReader.open(spark, path)
    assert sorted(r["path"] for r in reader.docs().collect()) == ["code.txt", "hello.txt"]
    assert reader.name(0) == "foo.txt" and reader.name(2) == "code.txt" and reader.name(99) is None
    assert sorted((r["path"], r["segment_idx"], r["local_id"]) for r in path_index(reader).collect()) == [("code.txt", 1, 0), ("hello.txt", 2, 0)]
    w.merge([s["id"] for s in meta["segments"][:2]])
    assert counts(spark, path)[:2] == (2, 2)
    assert sorted(r["path"] for r in SegmentReader.open(spark, path).docs().collect()) == ["code.txt", "hello.txt"]
    assert w.commit()["opstamp"] == 6  # nothing staged


def test_staging(spark, tmp_path):
    w = SegmentWriter(spark, f"file://{tmp_path}/seg", flush_threshold=3)
    w.add_file("a", "one text")
    w.add_file("a", "two text")
    w.add_file("b", "gone text")
    w.delete_file("b")
    w.commit()
    docs = SegmentReader.open(spark, w.path).docs().collect()
    assert [(r["path"], r["content"]) for r in docs] == [("a", "two text")]
    for i in range(3):
        w.add_file(f"f{i}", "hello")
    assert w.document_count == 4  # flushed by itself
    w.add_file("bad", "a\0b")
    assert total_docs(w.commit()) == 4


def test_global_ids(spark, tmp_path):
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    for n in ("a", "b", "c"):
        w.add_file(n, "hello")
        w.commit()
    got = SegmentReader.open(spark, w.path).lookup(HEL).collect()
    assert sorted((r["file_id"], r["global_id"], r["segment_idx"]) for r in got) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    sizes = spark.createDataFrame([(0, 5), (1, 7), (2, 1)], "ord int, num_docs long")
    assert [r["base"] for r in global_ids(sizes).orderBy("ord").collect()] == [0, 5, 12]
    assert live_docs({"segments": [{"num_docs": 100, "num_deleted_docs": 10}, {"num_docs": 200, "num_deleted_docs": 20}]}) == 270


def test_changes(spark):
    schema = "path string, mtime timestamp, size long"
    old = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("c", None, 3)], schema)
    new = spark.createDataFrame([("a", None, 1), ("b", None, 9), ("d", None, 4)], schema)
    assert sorted(tuple(r) for r in changes(old, new).collect()) == [("b", "modified"), ("c", "deleted"), ("d", "added")]


def test_tracker(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("hello a")
    (folder / "sub" / "b.txt").write_text("hello b")
    t = FileTracker(spark, f"file://{tmp_path}/state")
    t.add_directory(str(folder))
    t.add_directory(str(tmp_path / "missing"))
    assert t.pending().count() == 2 and t.has_pending_changes()
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    t.apply(w)
    assert not t.has_pending_changes() and t.file_count() == 2 and w.document_count == 2
    (folder / "a.txt").write_text("goodbye a, now longer")
    (folder / "sub" / "b.txt").unlink()
    assert sorted(r["change_type"] for r in t.pending().collect()) == ["deleted", "modified"]
    t.apply(w)
    assert counts(spark, w.path)[1:] == (1, 0)
    index = t.rebuild(f"file://{tmp_path}/v1")
    assert index.file_count == 1


def test_manager(spark, tmp_path):
    m = IndexManager(spark, f"file://{tmp_path}/all")
    w = m.open_writer("Title Only Index")
    assert w.path.endswith("/title-only-index")
    w.add_file("x", "hello")
    w.commit()
    assert m.open_reader("title only index").document_count == 1
    m.rebuild("Title Only Index", spark.createDataFrame([("p", "one"), ("q", "two")], "path string, content string"))
    assert m.open_reader("title-only-index").document_count == 2


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("hello a")
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    stream = streaming.watch(spark, str(folder))
    query = streaming.ingest(stream, w, str(tmp_path / "check"), window=None)
    query.awaitTermination()
    assert counts(spark, w.path) == (1, 1, 1)
    time.sleep(1.1)
    (folder / "b.txt").write_text("hello b")
    streaming.ingest(streaming.watch(spark, str(folder)), w, str(tmp_path / "check"), window=None).awaitTermination()
    assert counts(spark, w.path) == (2, 2, 2)


def test_latest(spark):
    rows = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "path string, content string, m long").withColumn("mtime", F.timestamp_seconds("m"))
    assert streaming.latest(rows).collect() == [("a", "new")]


def test_the_last_row_of_a_path_counts(spark, tmp_path):
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    rows = spark.createDataFrame([("a", "zzz first", 1), ("a", "aaa last", 2), ("b", "one", 1)], "path string, content string, n int")
    w.apply(rows, order="n")
    assert sorted((r["path"], r["content"]) for r in SegmentReader.open(spark, w.path).docs().collect()) == [("a", "aaa last"), ("b", "one")]
    tied = spark.createDataFrame([("a", "x", 1), ("a", None, 1), ("b", "p", 1), ("b", "q", 1)], "path string, content string, m long").withColumn("mtime", F.timestamp_seconds("m"))
    assert sorted(map(tuple, streaming.latest(tied).collect())) == [("a", None), ("b", "q")]


def test_a_change_during_apply_stays_pending(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("hello a")
    t = FileTracker(spark, f"file://{tmp_path}/state", [str(folder)])
    seen = t.snapshot()
    (folder / "b.txt").write_text("hello b")  # after the snapshot
    t.mark_indexed(seen)
    assert [(r["path"].rsplit("/", 1)[1], r["change_type"]) for r in t.pending().collect()] == [("b.txt", "added")]


def test_large_files_are_indexed_unless_bounded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "big.txt").write_text("needle in a line\n" * 700_000)  # over 10 MiB
    t = FileTracker(spark, f"file://{tmp_path}/state", [str(folder)])
    assert t.rebuild(f"file://{tmp_path}/ix").file_count == 1
    small = FileTracker(spark, f"file://{tmp_path}/state2", [str(folder)], max_bytes=1000)
    assert small.rebuild(f"file://{tmp_path}/ix2").file_count == 0


def test_watch_debounces(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("hello a")
    w = SegmentWriter(spark, f"file://{tmp_path}/seg")
    query = streaming.ingest(streaming.watch(spark, str(folder)), w, str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert counts(spark, w.path) == (1, 1, 1)
