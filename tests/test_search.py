import pytest
from pyspark.sql import functions as F

from trigrove.functions import trigrams as T
from trigrove.operators.fields import FieldIndex, FieldSearcher
from trigrove.operators.index import TrigramIndex, dense_ids
from trigrove.operators.positions import positional_postings, positions, proximity_pairs, proximity_search
from trigrove.operators.search import Searcher, SearchOptions, idf


def index(spark, docs):
    rows = [(i, n, c) for i, (n, c) in enumerate(docs.items())]
    return TrigramIndex.build(spark.createDataFrame(rows, "file_id long, name string, content string"))


def names(df):
    return [r["name"] for r in df.collect()]


def test_basic_and_verified(spark):
    ix = index(spark, {"partial.txt": "hello", "full.txt": "hello world", "none.txt": "goodbye"})
    assert names(Searcher(ix).search("hello world", 10)) == ["full.txt"]
    assert names(Searcher(ix).search("ab", 10)) == [] and names(Searcher(ix).search("xyz123", 10)) == []
    assert len(names(Searcher(ix).search("hello", 10))) == 2 and ix.file_count == 3


def test_false_positive(spark):
    assert names(Searcher(index(spark, {"abc_def.txt": "abc def ghi", "abcdef.txt": "abcdef"})).search("abcdef", 10)) == ["abcdef.txt"]


def test_snippets(spark):
    ix = index(spark, {"m.txt": "line one\nline two\nhello world here\nline four\nline five", "c.txt": "aaa\nbbb\nccc\ntarget here\nddd\neee\nfff\n", "r.txt": "foo bar foo baz foo"})
    hit = Searcher(ix).search("hello", 10).first()
    line = next(s for s in hit["snippets"] if s["matches"])
    assert (line["line_number"], line["byte_offset"], [tuple(m) for m in line["matches"]]) == (3, 18, [(0, 5)])
    hit = Searcher(ix).search("target", 10).first()
    assert [s["line_number"] for s in hit["snippets"]] == [2, 3, 4, 5, 6] and hit["match_count"] == 5
    hit = Searcher(ix, SearchOptions(context_lines=9)).search("target", 10).first()
    assert hit["snippets"][-1]["line_content"] == "fff\n"
    hit = Searcher(ix).search("foo", 10).first()
    assert [m["start"] for m in hit["snippets"][0]["matches"]] == [0, 8, 16]
    hit = Searcher(ix, SearchOptions(max_snippets_per_file=0)).search("target", 10).first()
    assert hit["match_count"] == 0
    ix = index(spark, {"x": "aaaa\nbb\naab"})
    assert [tuple(m) for s in Searcher(ix).search("aaa", 5).first()["snippets"] for m in s["matches"]] == [(0, 3), (1, 4)]
    assert [tuple(m) for s in Searcher(ix).search("bb\na", 5).first()["snippets"] for m in s["matches"]] == [(0, 4)]


def test_name_match(spark):
    hit = Searcher(index(spark, {"dir/special.txt": "nothing"})).search("special", 5).first()
    s = hit["snippets"][0]
    assert (hit["match_count"], s["line_number"], s["line_content"], tuple(s["matches"][0])) == (1, 0, "dir/special.txt", (4, 11))


def test_ranking(spark):
    ix = index(spark, {"both": "alpha beta gamma", "alpha_only": "alpha delta epsilon", "beta_only": "beta zeta theta"})
    assert names(Searcher(ix).search("alpha beta", 10))[0] == "both"
    ix = index(spark, {"a": "searchterm here", "b": "searchterm there too"})
    for mode in ("bm25", "trigram_count"):
        assert len(names(Searcher(ix, SearchOptions(ranking=mode)).search("searchterm", 10))) == 2
    assert idf(10, 3) > idf(10, 5) > 0
    assert names(Searcher(index(spark, {})).search("anything", 5)) == []


def test_candidate_cut(spark):
    docs = {f"d{i:02}": ("abc" if i < 6 else "abcdef") for i in range(12)}
    assert len(names(Searcher(index(spark, docs), SearchOptions(candidate_factor=None)).search("abcdef", 20))) == 6
    assert len(names(Searcher(index(spark, docs)).search("abcdef", 3))) <= 3


def test_regex(spark):
    ix = index(spark, {"nums.txt": "foo123bar baz456qux", "abc.txt": "abcdef", "ghi.txt": "abcghi", "xyz.txt": "xyzabc", "o.txt": "hellooooo world"})
    s = Searcher(ix)
    assert names(s.search_regex("foo[0-9]+bar", 10)) == ["nums.txt"]
    assert sorted(names(s.search_regex("abc(def|ghi)", 10))) == ["abc.txt", "ghi.txt"]
    assert names(s.search_regex("hello+", 10)) == ["o.txt"]
    assert names(s.search_regex("[0-9]{3}", 10)) == ["nums.txt"] and names(s.search_regex("(", 10)) == []
    got = s.search_regex("[a-z]+[0-9]+", 10).first()["snippets"][0]["matches"]
    assert [tuple(m) for m in got] == [(0, 6), (10, 16)]


def test_skipped_documents(spark):
    ix = index(spark, {"ok": "fine text", "nul": "a\0b", "long": "x" * 3000, "null": None, "tiny": ""})
    assert sorted(r["name"] for r in ix.docs.collect()) == ["ok", "tiny"]


def test_stored_index(spark, tmp_path):
    ix = index(spark, {"a": "hello", "b": "world", "c": "helloworld"}).write(f"file://{tmp_path}/ix")
    assert sorted(r["file_id"] for r in ix.lookup(b"hel".hex()).collect()) == [0, 2]
    assert ix.lookup(b"xyz".hex()).count() == 0 and ix.trigram_count == ix.dictionary().count()
    ids = spark.createDataFrame([(1,), (9,)], "file_id long")
    assert {r["file_id"]: r["name"] for r in ix.names(ids).collect()} == {1: "b", 9: None}
    assert {r["tri"]: r["file_ids"] for r in ix.lists().collect()}[b"wor".hex().upper()] == [1, 2]
    plan = ix.postings.where("tri = '68656C'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(tri), EqualTo(tri,68656C)]" in plan
    with pytest.raises(ValueError):
        TrigramIndex.open(spark, f"file://{tmp_path}/nothing")


def test_binary_documents(spark):
    rows = [(0, "a", bytearray("héllo".encode())), (1, "b", bytearray(b"\xff\xfe\xfd")), (2, "c", bytearray(b"he\0lo"))]
    ix = TrigramIndex.build(spark.createDataFrame(rows, "file_id long, name string, content binary"), binary=True)
    assert [r["name"] for r in ix.docs.collect()] == ["a"]
    assert names(Searcher(ix).search("héllo", 5)) == ["a"]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("file"))
    got = dense_ids(df.repartition(7), "k").collect()
    assert sorted((r["file_id"], r["k"]) for r in got) == [(i, i) for i in range(1000)]


def field_searcher(spark, rows, fields):
    return FieldSearcher(FieldIndex.build(spark.createDataFrame(rows, "file_id long, name string, field string, content string"), fields))


def test_fields(spark):
    rows = [(0, "doc1", "title", "search engine"), (0, "doc1", "body", "this is about databases and storage"), (1, "doc2", "title", "database intro"), (1, "doc2", "body", "search engine optimization tips")]
    s = field_searcher(spark, rows, ["title", "body"])
    got = s.search_with_fields("search engine", {"title": 3.0, "body": 1.0}, 10).collect()
    assert [r["name"] for r in got] == ["doc1", "doc2"] and got[0]["score"] > got[1]["score"]
    assert s.index.field_name(1) == "body" and s.index.field_name(7) is None
    assert s.search_with_fields("search engine", {}, 10).count() == 0 and s.search_with_fields("search engine", {"nope": 1.0}, 10).count() == 0
    rows = [(0, "doc1", "title", "hello"), (0, "doc1", "body", "world"), (1, "doc2", "title", "world"), (1, "doc2", "body", "hello")]
    s = field_searcher(spark, rows, ["title", "body"])
    assert [r["file_id"] for r in s.index.lookup(b"hel".hex(), "body").collect()] == [1]
    assert sorted((r["field_id"], r["df"]) for r in s.index.lookup_all(b"hel".hex()).collect()) == [(0, 1), (1, 1)]
    assert names(s.search_in_field("title", "hello")) == ["doc1"] or len(names(s.search_in_field("title", "hello"))) == 1
    assert len(names(s.search("hello"))) == 2


def test_field_counts(spark, tmp_path):
    rows = [(0, "a", "t", "abc"), (0, "a", "t", "abc"), (1, "b", "t", "x\0y"), (2, "c", "t", None), (3, "d", "u", "abc")]
    ix = FieldIndex.build(spark.createDataFrame(rows, "file_id long, name string, field string, content string"), ["t"]).write(f"file://{tmp_path}/f")
    assert ix.file_count == 4 and ix.pair_count == 1 and ix.postings.count() == 2 and ix.fields == ["t"]


def test_positions(spark):
    docs = spark.createDataFrame([(0, "test.txt", "abc abc def"), (1, "n", "hello 世界 abc")], "file_id long, name string, content string")
    full = positions(docs)
    assert sorted(r["byte_offset"] for r in full.where(F.col("tri") == "616263").where("file_id = 0").collect()) == [9, 13]
    r = full.where((F.col("tri") == "616263") & (F.col("file_id") == 1)).first()
    assert (r["byte_offset"], r["rune_offset"]) == (15, 11)
    compat = positions(docs, compat=True)
    assert compat.where("file_id = 1 and tri = '616263'").count() == 0
    assert compat.where("file_id = 1").agg(F.max("byte_offset")).first()[0] == 6
    assert compat.where("byte_offset != rune_offset").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "close.txt", "abc def ghi"), (1, "far.txt", "abc " + "x" * 32 + " def"), (2, "none.txt", "xyz only")], "file_id long, name string, content string")
    p = positional_postings(positions(docs))
    assert [r[0] for r in proximity_search(p, b"abc".hex(), b"def".hex(), 10).collect()] == [0]
    assert [r[0] for r in proximity_search(p, b"def".hex(), b"abc".hex(), 50).collect()] == [0, 1]
    assert proximity_pairs(p, b"abc".hex(), b"def".hex(), 10).collect() == [(0, 10, 14)]


def test_results_are_the_documents_that_hold_the_query(spark):
    docs = {f"n{i}": t for i, t in enumerate(["the cat", "cathedral", "dog", "scatter\ncat", "CAT", "ca t"])}
    ix = index(spark, docs)
    for q in ("cat", "cath", "the", "dog", "t\nc"):
        assert sorted(names(Searcher(ix, SearchOptions(candidate_factor=None)).search(q, 100))) == sorted(n for n, t in docs.items() if q in t)
    assert T.of_query("cat") == ["636174"]


def test_writers(spark, tmp_path):
    from trigrove import version
    from trigrove.operators.search import find_line
    from trigrove.operators.writers import FieldIndexWriter, IndexWriter, PositionalIndexWriter

    w = IndexWriter(spark)
    for name, content in (("a", "hello"), ("bad", "x\0y"), ("b", "help")):
        w.add_file(name, content)
    assert [(r["file_id"], r["name"]) for r in w.finish(f"file://{tmp_path}/v1").docs.orderBy("file_id").collect()] == [(0, "a"), (1, "b")]
    p = PositionalIndexWriter(spark)
    for name, content in (("test.txt", "abc abc def"), ("none", "x\0y"), ("u", "hello 世界" + "é" * 120)):
        p.add_file(name, content)
    ix = p.finish(f"file://{tmp_path}/v2")
    assert ix.file_count == 3 and ix.trigram_count > 5
    assert [x["byte_offset"] for x in ix.lookup(b"abc".hex()).first()["positions"]] == [9, 13]
    assert ix.rune_map(2) == [0, 100 + 4 + 90] and ix.rune_map(9) is None
    assert [tuple(r) for r in ix.counts().where("tri = '616263'").collect()] == [("616263", 1, 2)]
    assert [r[0] for r in ix.proximity_search(b"abc".hex(), b"def".hex(), 4).collect()] == [0]
    f = FieldIndexWriter(spark)
    assert (f.add_field("title"), f.add_field("body"), f.add_field("title")) == (0, 1, 0)
    f.add_file_field("doc", 0, "hello")
    f.add_file_field("doc", 1, "world")
    with pytest.raises(ValueError):
        f.add_file_field("doc", 2, "x")
    fx = f.finish(f"file://{tmp_path}/f1")
    assert fx.file_count == 1 and fx.pair_count == 6
    assert [find_line([0, 5, 9], k) for k in (0, 4, 5, 8, 9, 100)] == [0, 0, 1, 1, 2, 2] and version()


def test_driver_side_positions():
    from trigrove.operators.positions import extract_positions, rune_to_byte_offset

    assert extract_positions(0, "aé字".encode())[:3] == [("61C3A9", 0, 0), ("C3A9E5", 1, 1), ("A9E5AD", 2, 1)]
    with pytest.raises(ValueError):
        extract_positions(0, b"a\0b")
    assert [rune_to_byte_offset("aé字".encode(), k) for k in range(4)] == [0, 1, 3, 6]


def test_no_limit_returns_every_match_without_a_sort(spark):
    ix = index(spark, {f"dir/n{i}": f"foo{i}bar" if i % 2 else "other" for i in range(300)})
    odd = [f"dir/n{i}" for i in range(1, 300, 2)]
    for s in (Searcher(ix), Searcher(ix, SearchOptions(candidate_factor=None))):
        every = [s.search("foo", None), s.search_regex("foo[0-9]+bar", None), s.search_regex("[0-9]+", None)]
        for found in every:
            assert sorted(names(found)) == sorted(odd)
            assert "GlobalLimit" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Sort [" not in plan
        assert s.search("dir/", None).count() == 300
    assert Searcher(ix).search("foo", 0).count() == 0


def test_proximity_pairs_of_whole_texts(spark, tmp_path):
    """Against brute force, in texts that go on after characters beyond ASCII; compat mode stops there."""
    from trigrove.plans import catalog

    texts = ["a lion with wit", "é ion 字字 with nation", "ion" + "字" * 17 + "wit", "ion" + "字" * 18 + "wit", "nation" * 3 + "é" + "wit" * 4, None, ""]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        body = f"s/{i}\n{t or ''}"
        at = lambda x: [k for k in range(len(body)) if body.startswith(x, k)]
        want += [(i, a, b) for a in at("ion") for b in at("wit") if abs(a - b) <= 20]
    assert sorted(map(tuple, catalog.proximity_pairs(spark, f"file://{tmp_path}").collect())) == sorted(want)
    found = positional_postings(positions(catalog.documents(spark, f"file://{tmp_path}"), compat=True))
    assert {r[0] for r in proximity_pairs(found, b"ion".hex(), b"wit".hex(), 20).collect()} == {0} < {i for i, _, _ in want}


def test_lookups_prune(spark, tmp_path):
    """Postings and documents of a stored index are read by their keys, whatever the number of values."""
    ix = index(spark, {f"n{i}": f"needle {i} hay" if i % 2 else "straw" for i in range(80)}).write(f"file://{tmp_path}/ix")
    found = Searcher(ix).search("needle", 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    docs = next(line for line in plan.splitlines() if "FileScan" in line and "content" in line)
    assert "PushedFilters" in docs and "In(file_id" in docs
    assert found.count() == 20
    from trigrove.operators.search import hits

    plan = hits(ix.postings, T.of_query("a long query with many trigrams"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(tri") >= 2


def test_long_lists_come_in_parts(spark):
    ix = index(spark, {f"n{i}": "abc" for i in range(25)})
    rows = [r for r in ix.lists(10).collect() if r["tri"] == "616263"]
    assert sorted((r["part"], r["file_ids"]) for r in rows) == [(k, list(range(10 * k, min(25, 10 * k + 10)))) for k in range(3)]


def test_scanned_trigrams_are_those_of_the_expressions(spark, monkeypatch):
    """The numpy passes against the column expressions, in small runs too."""
    import random

    from trigrove.functions import scan

    r = random.Random(3)
    texts = [None, "", "ab", "abc", "x" * 2000, "x" * 2001, "x" * 1999 + "\n", "x" * 2000 + "\ny", "a\0b", "é字" * 9, "\n\n", "y\n" * 5] + ["".join(r.choices("ab\ncé", k=r.randint(0, 60))) for _ in range(80)]
    raws = [t if t is None else bytearray(t.encode()) for t in texts] + [bytearray(r.choices([0x41, 0x7F, 0x80, 0xBF, 0xC3, 0xE5, 0xF0, 0xF7, 0xF8, 0xFF, 0], k=r.randint(0, 6))) for _ in range(300)]
    for bound in (1 << 20, 64):
        monkeypatch.setattr(scan, "RUN_BYTES", bound)
        for rows, kind, binary in ((texts, "string", False), (raws, "binary", True)):
            df = spark.createDataFrame(list(enumerate(rows)), f"i int, t {kind}")
            want = df.where(T.admitted(F.col("t"), binary=binary))
            assert sorted(x.i for x in scan.admitted(df, ["t"], binary).collect()) == sorted(x.i for x in want.collect())
            got = sorted(map(tuple, scan.exploded(df, ["t"], ["i"], binary).collect()))
            assert got == sorted(map(tuple, want.select(F.explode(T.distinct_trigrams(F.col("t"))).alias("tri"), "i").collect()))
            every = sorted(map(tuple, scan.exploded(df, ["t"], ["i"], binary, limits=False).collect()))
            assert every == sorted(map(tuple, df.select(F.explode(T.distinct_trigrams(F.col("t"))).alias("tri"), "i").collect()))


def test_documents_beyond_the_limits_can_be_indexed(spark):
    docs = spark.createDataFrame([(0, "a", "x" * 3000 + " needle"), (1, "b", "a\0 needle"), (2, "c", None)], "file_id long, name string, content string")
    assert names(Searcher(TrigramIndex.build(docs)).search("needle", 5)) == []
    assert sorted(names(Searcher(TrigramIndex.build(docs, limits=False)).search("needle", 5))) == ["a", "b"]


REGEXES = ["(?i)HELLO", "[]abc]x", "[^]abc]x", "\\x68ello", "\\u0068ello", "[a[bc]d]ello", "hel[a-z&&[^m]]o", "\\Qa(b\\Ec", "(?x) he llo", "hello|(abc", "(hello)\\1", "h{1,2}ello", "a{0}hello", "hel+?lo", "(?:hel)?lo w", "^hello$", "\\bhello\\b", "\\p{Lower}ello", "(?<=h)ello", "é+字"]


def test_no_regex_loses_a_row(spark):
    """Whatever is required of candidates, the result is that of the full scan, with the places that Java's engine finds."""
    docs = {f"n{i}": t for i, t in enumerate(["hello", "HELLO", "]x", "ax", "dello", "bello", "a(bc", "hellohello", "hhello", "hello world", "éé字 x", "say hello\nhello", "lo w", "hel\nlo", "\ufdd0hello\ufdd1", "", "helo"])}
    ix = index(spark, docs)
    s = Searcher(ix, SearchOptions(candidate_factor=None))
    for p in REGEXES:
        try:
            want = sorted(r["name"] for r in ix.docs.where(F.col("content").rlike(p)).collect())
        except Exception:
            want = []  # not valid
        assert sorted(names(s.search_regex(p, 100))) == want, p
    hit = {r["name"]: [tuple(m) for line in r["snippets"] for m in line["matches"]] for r in s.search_regex("hello", 100).collect()}
    assert hit["n11"] == [(4, 9), (0, 5)] and hit["n14"] == [(3, 8)] and hit["n7"] == [(0, 5), (5, 10)]


@pytest.mark.parametrize("seed", range(2))
def test_random_regexes_lose_no_row(spark, seed):
    import random

    r = random.Random(seed)
    texts = ["".join(r.choices("abcABC]-[&x1", k=r.randint(0, 14))) for _ in range(60)]
    ix = index(spark, {f"n{i}": t for i, t in enumerate(texts)})
    s = Searcher(ix, SearchOptions(candidate_factor=None))
    pieces = ["abc", "bca", "a", "b?", "c*", "(?i)", "(ab|c)", "[]a]", "[^b]", "[a[b]]", "\\x61", "|", "{2}", "+", ".", "\\Q", "\\E", "\\]", "x1", "(?:a)"]
    for _ in range(10):
        p = "".join(r.choices(pieces, k=r.randint(1, 5)))
        try:
            want = sorted(x["name"] for x in ix.docs.where(F.col("content").rlike(p)).collect())
        except Exception:
            want = []
        assert sorted(names(s.search_regex(p, None))) == want, p
