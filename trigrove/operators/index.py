"""The trigram index: documents, long-form postings and the dictionary derived from them.

Postings are one row per distinct (trigram, document), written range-partitioned
and sorted by trigram, so a lookup reads the row groups whose statistics hold
the trigram.  Names are searchable: the indexed text is the name, a line feed
and the content.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..sources import store

FORMAT = "trigrove-index-1"
#: Bytes of a row group of stored documents: small, so that a lookup by id reads little.
DOC_GROUP = 8 << 20
#: Ids of a row of a posting list, at most.
LIST_IDS = 1 << 16


def dense_ids(docs: DataFrame, *order: str, column: str = "file_id") -> DataFrame:
    """Ids 0, 1, 2, ... in the order of the given columns, without one task that sees all rows.

    Rows are range-partitioned and sorted; each partition numbers its own rows
    from the sum of the sizes before it (one number a partition is gathered).
    """
    spark = docs.sparkSession
    keyed = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    keyed = store.fixed(keyed)
    sizes = {r["p"]: r["n"] for r in keyed.groupBy(F.shiftright("__id", 33).alias("p")).count().withColumnRenamed("count", "n").collect()}
    rows, at = [], 0
    for p in sorted(sizes):
        rows.append((p, at))
        at += sizes[p]
    bases = spark.createDataFrame(rows or [(0, 0)], "p long, base long")
    joined = keyed.join(F.broadcast(bases), F.shiftright("__id", 33) == F.col("p"))
    return joined.withColumn(column, F.col("base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "p", "base")


def indexed_text(content: Column, name: Column) -> Column:
    return F.concat(name, F.lit("\n"), content)


#: Trigrams up to which a search of texts that aren't indexed looks for each of them.
FEW_TRIGRAMS = 64


@dataclass(frozen=True)
class Texts:
    """The rows that an index is built of, with whole-numbered ids."""

    rows: DataFrame
    texts: list[str]
    key: str = "file_id"
    group: str | None = None
    binary: bool = False
    limits: bool = True

    def lists(self) -> DataFrame:
        return scan.listed(self.rows, self.texts, self.key, self.group, self.binary, self.limits)

    def found(self, tris: list[str]) -> DataFrame | None:
        """The postings of a few trigrams, without the others; None where they can't be had so."""
        if not tris or len(tris) > FEW_TRIGRAMS or self.binary or any(dict(self.rows.dtypes)[c] != "string" for c in self.texts):
            return None
        return scan.found(self.rows, self.texts, [*([self.group] if self.group else []), self.key], tris, self.limits)

    @classmethod
    def of(cls, rows: DataFrame, texts: list[str], group: str | None = None, binary: bool = False, limits: bool = True) -> Texts | None:
        return cls(rows, texts, "file_id", group, binary, limits) if scan.integral(rows, "file_id") else None


def write_postings(texts: Texts, path: str, **constant: str) -> None:
    """Postings ``tri, group, key`` in ranges and sorted, as a table; ``constant`` columns come with them.

    They are shuffled as lists and become rows as they are written.
    """
    rows = scan.postings_of(scan.blocks(texts.lists(), ordered=True), texts.key)
    kind = dict(texts.rows.dtypes)[texts.key]
    rows = rows.withColumn(texts.key, F.col(texts.key).cast(kind)).withColumns({c: F.lit(v) for c, v in constant.items()})
    rows.write.mode("overwrite").parquet(path)


@dataclass
class TrigramIndex:
    """``docs(file_id, name, content)`` that were admitted, and their ``postings(tri, file_id)``; ``texts``: what they are made of."""

    docs: DataFrame
    postings: DataFrame
    meta: dict = field(default_factory=dict)
    texts: Texts | None = None

    @classmethod
    def build(cls, docs: DataFrame, binary: bool = False, limits: bool = True) -> TrigramIndex:
        """Index ``docs(file_id, name, content)``; documents that break an admission rule are left out.

        Null contents are left out too; a null name counts as empty.  A text
        under three bytes is a document without postings.  ``limits=False``
        admits every content that isn't null.
        """
        full = docs.select("file_id", F.coalesce("name", F.lit("")).alias("name"), "content")
        texts = ["name", "content"]
        return cls(scan.admitted(full, texts, binary, limits), scan.exploded(full, texts, ["file_id"], binary, limits), texts=Texts.of(full, texts, None, binary, limits))

    def write(self, path: str) -> TrigramIndex:
        """Persist as Parquet and return the stored index: postings sorted by trigram, documents by id."""
        spark = self.docs.sparkSession
        if self.texts is not None:
            write_postings(self.texts, f"{path}/postings")
        else:
            self.postings.repartitionByRange("tri", "file_id").sortWithinPartitions("tri", "file_id").write.mode("overwrite").parquet(f"{path}/postings")
        write_docs(self.docs, f"{path}/docs")
        store.write_json(spark, f"{path}/index.json", {"format": FORMAT, "files": spark.read.parquet(f"{path}/docs").count()})
        return self.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TrigramIndex:
        meta = store.read_json(spark, f"{path}/index.json")
        if meta is None or meta.get("format") != FORMAT:
            raise ValueError(f"no index of format {FORMAT} at {path}")
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), meta)

    @cached_property
    def file_count(self) -> int:
        return self.meta["files"] if "files" in self.meta else self.docs.count()

    @cached_property
    def trigram_count(self) -> int:
        return self.postings.select("tri").distinct().count()

    def dictionary(self) -> DataFrame:
        """``tri, df``."""
        return self.postings.groupBy("tri").agg(F.count("*").alias("df"))

    def lists(self, most: int = LIST_IDS) -> DataFrame:
        """``tri, part, file_ids``: posting lists for export, a long one in parts of at most ``most`` ids, in order.

        Ids are counted by blocks of them, and parts cut at multiples of an
        id's rank, so no task holds a whole hot list.  Null ids are left out.
        """
        if not scan.integral(self.postings, "file_id"):
            return self._lists_by_rank(most)
        found = scan.gathered(self.postings, "file_id") if self.texts is None else self.texts.lists().where("block is not null")
        held = store.fixed(scan.blocks(found))
        before = Window.partitionBy("tri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block: 65,536 ids
        firsts = held.select("tri", "block", F.size("offs").cast("long").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        cut = held.join(firsts, ["tri", "block"]).withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / most), F.floor((F.col("first") + F.col("n") - 1) / most))))
        start = F.greatest(F.col("part") * most - F.col("first"), F.lit(0))
        end = F.least((F.col("part") + 1) * most - F.col("first"), F.col("n"))
        offs = F.slice("offs", (start + 1).cast("int"), (end - start).cast("int"))
        kind = dict(self.postings.dtypes)["file_id"]
        pieces = cut.select("tri", "part", F.struct("block", F.transform(offs, lambda o: scan.id_of(F.col("block"), o).cast(kind)).alias("ids")).alias("piece"))
        whole = F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["ids"]))
        return pieces.groupBy("tri", "part").agg(whole.alias("file_ids"))

    def _lists_by_rank(self, most: int) -> DataFrame:
        ranked = dense_ids(self.postings, "tri", "file_id", column="__rank")
        first = ranked.groupBy("tri").agg(F.min("__rank").alias("__first"))
        part = F.floor((F.col("__rank") - F.col("__first")) / most).alias("part")
        return ranked.join(first, "tri").groupBy("tri", part).agg(F.sort_array(F.collect_list("file_id")).alias("file_ids"))

    def hits(self, tris: list[str]) -> DataFrame | None:
        """The postings of a few trigrams, where they needn't be looked up among all."""
        return self.texts.found(tris) if self.texts is not None else None

    def lookup(self, tri: str) -> DataFrame:
        """Ids of the documents with a trigram."""
        return self.postings.where(F.col("tri") == tri.upper()).select("file_id")

    def names(self, ids: DataFrame) -> DataFrame:
        """``file_id, name`` of the ids; the name of an unknown id is null."""
        return ids.join(self.docs.select("file_id", "name"), "file_id", "left")


def write_docs(docs: DataFrame, path: str) -> None:
    """Documents sorted by id in small row groups, so that those of some ids are read without the others."""
    docs.repartitionByRange("file_id").sortWithinPartitions("file_id").write.option("parquet.block.size", DOC_GROUP).mode("overwrite").parquet(path)


def global_ids(segments: DataFrame) -> DataFrame:
    """``base`` of each row of ``segments(ord, num_docs)``: documents in the segments before it."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment: a manifest's size
    return segments.withColumn("base", F.coalesce(F.sum("num_docs").over(before), F.lit(0)))
