"""From raw documents to packed sequences: quality rules, language ID, line dedup, near-dedup, packing.

Each stage works on all rows that the one before it kept and is written as
Parquet in the shared folder before the next one reads it.  All stages but the
last return the columns that they were given, whatever their names, with their
values (line dedup changes ``text`` and ``n_chars``).

Edge cases: a null or empty text fails the quality rules, so the later stages
don't see it in the pipeline; given one, they reject it (language ID) or keep it
(line dedup, near-dedup; packing makes it one closing id).  Rows without an id
are kept by all stages that don't reject their text.  Repeated rows: line dedup
cuts rows of one id and text alike, near-dedup keeps or drops all rows of an id
and compares rows of one id that had different texts only as they are.
Of documents that tie, the smallest id stays.  An empty table gives an empty
table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm import langid, linededup, minhash, packing, quality
from trigrove.llm._store import drop, exists, sieved, written
from trigrove.llm.queries import tokenizer_path
from trigrove.plans.session import ship


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows of an Arrow batch, at most: an executor holds several copies of a batch of texts for each task.
BATCH_ROWS = 1000
#: Share of a text that line dedup may cut before near-dedup compares the uncut text too.
LOST = 0.15


def _safe(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator uses for its own columns, and those names."""
    safe = docs.toDF(*(f"__column{i}" for i in range(len(docs.columns))))
    return safe, dict(zip(docs.columns, safe.columns))


def _restored(found: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*names.values()).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    safe, n = _safe(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", n["doc_id"])
    model = quality.fit(safe, labels, text=n["text"], key=n["doc_id"])
    return _restored(quality.quality_rules(safe, model, text=n["text"]).where("kept"), docs, n)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (they have no letter) go."""
    safe, n = _safe(docs)
    model = langid.fit(safe, text=n["text"], lang=n["lang"], key=n["doc_id"])
    found = langid.identify(safe, model, text=n["text"])
    return _restored(found.where(F.col("lang_pred") != langid.UNKNOWN), docs, n)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents of which no line is left go."""
    safe, n = _safe(docs)
    cut = linededup.line_dedup(safe, text=n["text"], key=n["doc_id"]).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in n:
        cut = cut.withColumn(n["n_chars"], F.char_length(n["text"]).cast("long"))
    return _restored(cut, docs, n)


def _uncut(own: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, form`` of the documents that lost much, ``form`` being an id that no document has, and ``form, text`` as they were.

    Rows of ``whole`` count only where all of one id have one text: of several it
    can't be told which ones the stages before this one have rejected.
    """
    hashed = F.xxhash64("text")
    before = whole.groupBy("key").agg(F.max(F.octet_length("text")).alias("before"), (F.min(hashed) == F.max(hashed)).alias("one")).where("one")
    shorter = own.select("key", F.octet_length("text").alias("now")).join(before, "key").where(F.col("now") < F.col("before") * F.lit(1 - LOST))
    lost = written(shorter.select("key").distinct(), "pipeline-lost")
    for salt in count():
        named = lost.select("key", F.xxhash64("key", F.lit(salt)).alias("form"))
        used = own.select("key").distinct().union(named.select("form"))
        if used.groupBy("key").count().where("count > 1").isEmpty():
            # only the texts of documents that lost much are fetched, once
            return named, written(sieved(whole, F.col("key"), lost).join(named, "key").select("form", "text"), "pipeline-uncut")
    raise AssertionError


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    All documents are compared as they are.  Those that lost more than a share
    of :data:`LOST` of their text to line dedup are first compared as they were:
    a near copy that lost the lines it shares with its original is still found.
    Of the documents that this leaves, the smallest id of each group of what the
    texts are now stays, so no two near duplicates remain.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), "text")
    path = f"{sf_dir}/documents.parquet"
    if exists(spark, path):
        whole = spark.read.parquet(path).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), "text")
        named, uncut = _uncut(own, whole)
        found = minhash.near_duplicates(own.union(uncut), key="key").select(F.col("doc_id").alias("form"), F.col("component_id").alias("c"))
        found = found.join(named.withColumnRenamed("key", "was"), "form", "left").select(F.coalesce("was", "form").alias("key"), F.col("was").isNotNull().alias("uncut"), "c")
        found = written(found.join(named.select("key", F.lit(True).alias("lost")), "key", "left"), "pipeline-groups")
        drop(uncut)
        first = found.where("uncut or lost is null")
        gone = _later(first)
        left = found.where("not uncut").join(gone, F.col("key") == F.col("__gone"), "left_anti")
        gone = gone.union(_later(left)).distinct()
    else:
        gone = minhash.near_duplicates(own, key="key").where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def _later(found: DataFrame) -> DataFrame:
    """Ids in groups ``c`` that have a smaller id."""
    least = found.groupBy("c").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("c", "least")
    return written(found.join(least, "c").where("key > least").select(F.col("key").alias("__gone")).distinct(), "pipeline-gone")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, with their sequences and offsets."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


def _small_batches(stage: Stage) -> Stage:
    """The stage with batches of at most :data:`BATCH_ROWS` rows; the setting stays, since its result is computed later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _small_batches(quality_stage)),
    ("language id", _small_batches(language_stage)),
    ("line dedup", _small_batches(line_stage)),
    ("near dedup", _small_batches(near_dup_stage)),
    ("packing", _small_batches(packing_stage)),
]

#: The verdicts of the n-gram ratio and of the language model can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
