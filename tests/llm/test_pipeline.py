import json
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import edges, test_linededup, test_minhash, test_quality
from trigrove.llm import _text as X
from trigrove.llm import quality, queries

DATA = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and set(queries.ORACLES) <= names


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, DATA), "test")
        if name != "packing":
            assert out.columns == columns and out.count() <= docs.count()
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()


def test_edge_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (edges.frame(spark), edges.empty(spark)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        docs.count()


def test_import_without_the_subpackage(tmp_path):
    """The entry module works in a copy without the optional parts."""
    import shutil

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "trigrove", tmp_path / "trigrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    names, sql = json.loads(said.stdout)
    assert "search_bm25" in names and not any(n.startswith("op") or n == "pipeline" for n in names) and set(sql) <= set(names)


def test_stages_match_brute_force(spark):
    """Each stage's rows, from plain Python over the whole small table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def trusted(text):
        part = next(iter(X.texts(pa.array([text]))))
        bucket = quality.features(X.words(part))[0]
        return sum(model.ratio[b] for b in bucket) / max(1, len(bucket)) >= model.threshold

    texts = {i: t for i, t in whole.items() if not test_quality.brute(t)["base_failed"] and trusted(t)}
    docs = corpus_pipeline.written(stages["quality rules"](spark, docs, DATA), "test")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    texts = {i: t for i, t in texts.items() if any(c.isalpha() for c in t)}
    docs = corpus_pipeline.written(stages["language id"](spark, docs, DATA), "test")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    cut = test_linededup.brute(sorted(texts.items()), 10)
    texts = {i: t for i, (t, n, gone) in cut.items() if not gone or gone < n}
    docs = corpus_pipeline.written(stages["line dedup"](spark, docs, DATA), "test")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    size = lambda t: len(t.encode())
    component, _ = test_minhash.brute([(i, whole[i] if size(t) < 0.85 * size(whole[i]) else t) for i, t in texts.items()])
    texts = {i: t for i, t in texts.items() if component[i] == i}
    docs = corpus_pipeline.written(stages["near dedup"](spark, docs, DATA), "test")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    packed = corpus_pipeline.written(stages["packing"](spark, docs, DATA), "test").collect()
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 1024
    assert set(sizes) == set(texts) and all(sizes[r["doc_id"]] == r["doc_tokens"] for r in packed)


def test_clashing_columns_pass_through(spark, tmp_path):
    """Columns with the names that operators give their own results keep their values."""
    names = ["kept", "llr", "lang_pred", "score", "bits", "n_lines", "n_removed", "component_id", "n_words"]
    text = " ".join(f"word{i % 97} and{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{text} tail{i * 7}" * (i + 1), "en", "s", 1, *[f"own{i}"] * len(names)) for i in range(3)], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.count() > 0 and docs.columns[5:] == names, name
        assert all(r[n] == f"own{r['doc_id']}" for r in docs.collect() for n in names), name


def _words(name, n):
    return [" ".join(f"{name}{i}x{j}" for j in range(12)) for i in range(n)]


def test_near_dedup_follows_line_dedup(spark, tmp_path):
    """What line dedup leaves of two texts is compared, and what it rejected doesn't come back."""
    stages = dict(corpus_pipeline.STAGES)
    one, two, other = _words("one", 12), _words("two", 12), _words("other", 6)
    rest = _words("rest", 8)
    near = [f"{line} more{i}" for i, line in enumerate(rest)]
    rows = [(1, one), (2, two), (3, one + rest), (4, two + near), (5, one), (5, other)]
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.written(stages["line dedup"](spark, docs, str(tmp_path)), "test")
    assert {r["doc_id"]: r["text"].split("\n") for r in cut.collect()} == {1: one, 2: two, 3: rest, 4: near, 5: other}
    left = stages["near dedup"](spark, cut, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 5]


def test_near_dedup_keeps_one_of_what_is_left(spark, tmp_path):
    """A document that goes as a near copy of its original takes no other one along."""
    one, two, rest = _words("one", 40), _words("two", 12), _words("rest", 8)
    near = [f"{line} more{i}" for i, line in enumerate(rest)]
    rows = [(1, one), (2, two), (3, one + rest), (4, two + near)]
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i, lines in rows], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    cut = corpus_pipeline.written(stages["line dedup"](spark, docs, str(tmp_path)), "test")
    left = stages["near dedup"](spark, cut, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]


def test_stages_take_small_batches(spark):
    """Also what a stage returns and what is computed later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    try:
        spark.conf.set(name, "10000")
        docs = spark.createDataFrame([], "doc_id long, text string")
        for _, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.set(name, "10000")
            stage(spark, docs, "/nowhere")
            found = [r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()]
            assert sum(found) == 5000 and max(found) <= 1000
    finally:
        spark.conf.set(name, before)
