"""An index of named fields, and search with a boost for each field."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import trigrams as T
from ..sources import store
from .index import Texts, TrigramIndex, write_docs, write_postings
from .search import Searcher, SearchOptions, _bytes, _lines_around, _name_snippet, _with_snippets, best, documents_of, hits, idf, literal_spans

FORMAT = "trigrove-fields-1"


@dataclass
class FieldIndex:
    """``docs(file_id, name, content)``, ``fields`` in order, and ``postings(tri, field_id, file_id)``.

    The content, for verification, is all fields' texts, one after the other.
    """

    docs: DataFrame
    fields: list[str]
    postings: DataFrame
    meta: dict = field(default_factory=dict)
    texts: Texts | None = None

    @classmethod
    def build(cls, rows: DataFrame, fields: list[str], limits: bool = True) -> FieldIndex:
        """Index ``rows(file_id, name, field, content)``.

        A document counts even if none of its fields is admitted.  A field that
        is added to a document twice has its postings twice.  Fields that
        aren't registered, and null contents, give no postings.  ``limits=False``
        admits every content.
        """
        names = list(dict.fromkeys(fields))
        number = F.array_position(F.array(*(F.lit(f) for f in names)), F.col("field")) - 1 if names else F.lit(-1)
        good = rows.withColumn("field_id", number.cast("int")).where("field_id >= 0")
        postings = scan.exploded(good, ["content"], ["field_id", "file_id"], limits=limits)
        body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number.alias("f"), "content"))), lambda x: x["content"]), "\n")
        docs = rows.groupBy("file_id").agg(F.min("name").alias("name"), body.alias("content"))
        return cls(docs, names, postings, texts=Texts.of(good, ["content"], "field_id", limits=limits))

    @classmethod
    def from_columns(cls, docs: DataFrame, fields: list[str]) -> FieldIndex:
        """Index some columns of ``docs(file_id, name, ...)`` as fields."""
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("content")) for f in fields))
        return cls.build(docs.select("file_id", "name", F.explode(pairs).alias("x")).select("file_id", "name", "x.*"), fields)

    def write(self, path: str) -> FieldIndex:
        spark = self.docs.sparkSession
        if self.texts is not None:
            write_postings(self.texts, f"{path}/postings")
        else:
            self.postings.repartitionByRange("tri", "field_id", "file_id").sortWithinPartitions("tri", "field_id", "file_id").write.mode("overwrite").parquet(f"{path}/postings")
        write_docs(self.docs, f"{path}/docs")
        store.write_json(spark, f"{path}/fields.json", {"format": FORMAT, "fields": self.fields, "files": spark.read.parquet(f"{path}/docs").count()})
        return self.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FieldIndex:
        meta = store.read_json(spark, f"{path}/fields.json")
        if meta is None or meta.get("format") != FORMAT:
            raise ValueError(f"no field index of format {FORMAT} at {path}")
        return cls(spark.read.parquet(f"{path}/docs"), meta["fields"], spark.read.parquet(f"{path}/postings"), meta)

    @cached_property
    def file_count(self) -> int:
        return self.meta["files"] if "files" in self.meta else self.docs.count()

    @cached_property
    def pair_count(self) -> int:
        """Distinct (trigram, field) pairs."""
        return self.postings.select("tri", "field_id").distinct().count()

    def field_name(self, field_id: int) -> str | None:
        return self.fields[field_id] if 0 <= field_id < len(self.fields) else None

    def lookup(self, tri: str, field: str) -> DataFrame:
        return self.postings.where((F.col("tri") == tri.upper()) & (F.col("field_id") == self.fields.index(field))).select("file_id")

    def lookup_all(self, tri: str) -> DataFrame:
        """``field_id, df`` of each field that holds a trigram."""
        return self.postings.where(F.col("tri") == tri.upper()).groupBy("field_id").agg(F.count("*").alias("df"))


@dataclass
class FieldSearcher:
    index: FieldIndex
    options: SearchOptions = SearchOptions()

    def ranked(self, tris: list[str], boosts: dict[str, float]) -> DataFrame:
        """``file_id, matched, score``: the sum of boost times inverse document frequency over (trigram, field) hits."""
        weights = {self.index.fields.index(f): w for f, w in boosts.items()}
        found = self.index.texts.found(tris) if self.index.texts is not None else None
        found = (hits(self.index.postings, tris) if found is None else found).where(F.col("field_id").isin(list(weights)))
        n = self.index.file_count
        table = [(r["tri"], r["field_id"], weights[r["field_id"]] * idf(n, r["n"])) for r in found.groupBy("tri", "field_id").agg(F.count("*").alias("n")).collect()]  # a row for each pair asked for
        scored = found.join(F.broadcast(found.sparkSession.createDataFrame(table, "tri string, field_id int, w double")), ["tri", "field_id"])
        summed = scored.groupBy("file_id").agg(F.count("*").alias("matched"), F.sum("w").alias("score"))
        # equal sums in another order may differ in their last bits, so ties are made on nine decimals
        return summed.withColumn("rank_key", F.round("score", 9))

    def search_with_fields(self, query: str, boosts: dict[str, float], max_results: int = 100) -> DataFrame:
        tris = T.of_query(query)
        boosts = {f: w for f, w in boosts.items() if f in self.index.fields}
        if not tris or not boosts or max_results <= 0:
            return Searcher(TrigramIndex(self.index.docs, self.index.postings)).empty()
        o, raw = self.options, query.encode()
        most = None if o.candidate_factor is None else o.candidate_factor * max_results
        ranked = self.ranked(tris, boosts)
        found = documents_of(ranked if most is None else best(ranked, most), self.index.docs, most).where(F.contains("name", F.lit(query)) | F.contains("content", F.lit(query)))

        def make(name: str, content: object) -> list[dict] | None:
            if raw in name.encode():
                return _name_snippet(name.encode(), raw)
            data = _bytes(content)
            spans = literal_spans(data, raw)
            return _lines_around(data, spans, o.context_lines, o.max_snippets_per_file) if spans else None

        return best(_with_snippets(found, make), max_results)

    def search_in_field(self, field: str, query: str, max_results: int = 100) -> DataFrame:
        return self.search_with_fields(query, {field: 1.0}, max_results)

    def search(self, query: str, max_results: int = 100) -> DataFrame:
        """All fields, with weight 1."""
        return self.search_with_fields(query, dict.fromkeys(self.index.fields, 1.0), max_results)
