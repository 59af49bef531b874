"""A segmented index: immutable Parquet segments under a manifest that one rename replaces.

Readers use the segments and deletion generations that their manifest names
and nothing else, so a failed or repeated write leaves files that no one reads.
One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.names import segment_id
from ..operators.index import DOC_GROUP, Texts, dense_ids, write_postings
from . import store

FLUSH_THRESHOLD = 10_000


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a folder; a new one where there is none."""
    return store.read_json(spark, f"{path}/meta.json") or {"version": 1, "opstamp": 0, "segments": []}


def total_docs(meta: dict) -> int:
    return sum(s["num_docs"] for s in meta["segments"])


def live_docs(meta: dict) -> int:
    return sum(s["num_docs"] - s["num_deleted_docs"] for s in meta["segments"])


@dataclass
class SegmentReader:
    """A snapshot of the index."""

    spark: SparkSession
    path: str
    meta: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentReader:
        return cls(spark, path, manifest(spark, path))

    @property
    def segment_count(self) -> int:
        return len(self.meta["segments"])

    @property
    def document_count(self) -> int:
        return live_docs(self.meta)

    def segments(self) -> DataFrame:
        """``ord, segment_id, num_docs, num_deleted_docs, base``: a row for each entry of the manifest."""
        rows, base = [], 0
        for i, s in enumerate(self.meta["segments"]):
            rows.append((i, s["id"], s["num_docs"], s["num_deleted_docs"], base))
            base += s["num_docs"]
        return self.spark.createDataFrame(rows, "ord int, segment_id string, num_docs long, num_deleted_docs long, base long")

    def _table(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/segment_id={s['id']}/{kind}" for s in self.meta["segments"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def deletions(self) -> DataFrame:
        """``segment_id, local_id``."""
        paths = [f"{self.path}/deletes/{s['id']}-{g}" for s in self.meta["segments"] for g in range(1, s["del_gen"] + 1)]
        schema = "segment_id string, local_id long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """Live documents: ``segment_id, local_id, global_id, path, content``."""
        rows = self._table("docs", "segment_id string, local_id long, path string, content string").join(self.deletions(), ["segment_id", "local_id"], "left_anti")
        return rows.join(F.broadcast(self.segments().select("segment_id", "base")), "segment_id").select("segment_id", "local_id", (F.col("base") + F.col("local_id")).alias("global_id"), "path", "content")

    def postings(self) -> DataFrame:
        return self._table("postings", "tri string, segment_id string, local_id long").join(self.deletions(), ["segment_id", "local_id"], "left_anti")

    def lookup(self, tri: str) -> DataFrame:
        """``file_id, global_id, segment_idx`` of the live documents with a trigram."""
        found = self._table("postings", "tri string, segment_id string, local_id long").where(F.col("tri") == tri.upper())
        live = found.join(self.deletions(), ["segment_id", "local_id"], "left_anti")
        return live.join(F.broadcast(self.segments()), "segment_id").select(F.col("local_id").alias("file_id"), (F.col("base") + F.col("local_id")).alias("global_id"), F.col("ord").alias("segment_idx"))

    def trigram_count(self) -> int:
        return self._table("postings", "tri string, segment_id string, local_id long").select("tri").distinct().count()

    def name(self, global_id: int) -> str | None:
        """Path of a document by its global id, deleted or not; None beyond the end."""
        base = 0
        for s in self.meta["segments"]:
            if base <= global_id < base + s["num_docs"]:
                row = self.spark.read.parquet(f"{self.path}/segments/segment_id={s['id']}/docs").where(F.col("local_id") == global_id - base).select("path").first()
                return row and row["path"]
            base += s["num_docs"]
        return None


@dataclass
class SegmentWriter:
    """Staged additions and deletions, applied together by :meth:`commit`.

    Of a path that is added twice before a commit the last content counts; a
    deletion cancels what was staged before it.
    """

    spark: SparkSession
    path: str
    flush_threshold: int = FLUSH_THRESHOLD
    limits: bool = True
    staged: dict[str, str | None] = field(default_factory=dict)

    def add_file(self, path: str, content: str) -> None:
        self.staged.pop(path, None)
        self.staged[path] = content
        if sum(c is not None for c in self.staged.values()) >= self.flush_threshold:
            self.commit()

    def delete_file(self, path: str) -> None:
        self.staged.pop(path, None)
        self.staged[path] = None

    @property
    def segment_count(self) -> int:
        return len(manifest(self.spark, self.path)["segments"])

    @property
    def document_count(self) -> int:
        """Live documents as committed."""
        return live_docs(manifest(self.spark, self.path))

    def commit(self) -> dict:
        rows = list(self.staged.items())
        changes = self.spark.createDataFrame(rows, "path string, content string")
        meta = self.apply(changes.where("content is not null"), changes.select("path"))
        self.staged.clear()
        return meta

    def apply(self, added: DataFrame, replaced: DataFrame | None = None, order: str | None = None) -> dict:
        """Commit a table ``added(path, content)`` as one segment, in path order, replacing documents of its paths.

        ``replaced(path)`` lists the paths whose old documents go; the added
        ones, if not given.  Of a path that is there more than once, the row
        with the greatest value of the column ``order`` counts (ties: the
        greatest content); without it the rows of a table have no order, and
        the greatest content counts.  Texts that break an admission rule aren't
        stored, unless ``limits`` is off.
        """
        meta = manifest(self.spark, self.path)
        gone = (added if replaced is None else replaced).select("path").distinct()
        reader = SegmentReader(self.spark, self.path, meta)
        old = reader.docs().join(gone, "path", "left_semi").select("segment_id", "local_id") if meta["segments"] else None
        segments = self._with_deletions(meta["segments"], old)
        last = F.max("content") if order is None else F.max_by("content", F.struct(F.col(order), F.col("content")))
        unique = added.groupBy("path").agg(last.alias("content"))
        made = self._segment(unique)
        if made:
            segments.append(made)
        meta = {"version": meta["version"], "opstamp": meta["opstamp"] + 1, "segments": segments}
        store.write_json(self.spark, f"{self.path}/meta.json", meta)
        return meta

    def _with_deletions(self, segments: list[dict], old: DataFrame | None) -> list[dict]:
        if old is None:
            return list(segments)
        counts = {r["segment_id"]: r["n"] for r in old.groupBy("segment_id").agg(F.count("*").alias("n")).collect()}  # a row a segment
        out = []
        for s in segments:
            if n := counts.get(s["id"]):
                old.where(F.col("segment_id") == s["id"]).write.parquet(f"{self.path}/deletes/{s['id']}-{s['del_gen'] + 1}")
                s = s | {"num_deleted_docs": s["num_deleted_docs"] + n, "has_deletions": True, "del_gen": s["del_gen"] + 1}
            out.append(s)
        return out

    def _segment(self, docs: DataFrame) -> dict | None:
        own = segment_id()
        target = f"{self.path}/segments/segment_id={own}"
        full = scan.admitted(docs.select("path", "content"), ["path", "content"], limits=self.limits)
        numbered = dense_ids(full, "path", column="local_id").withColumn("segment_id", F.lit(own))
        if numbered.isEmpty():
            return None
        numbered.select("segment_id", "local_id", "path", "content").write.option("parquet.block.size", DOC_GROUP).parquet(f"{target}/docs")
        stored = self.spark.read.parquet(f"{target}/docs")
        write_postings(Texts(stored, ["path", "content"], "local_id", limits=False), f"{target}/postings", segment_id=own)
        count = self.spark.read.parquet(f"{target}/docs").count()
        return {"id": own, "num_docs": count, "num_deleted_docs": 0, "has_deletions": False, "del_gen": 0}

    def merge(self, ids: list[str]) -> dict:
        """Replace segments by one that holds their live documents; it comes last."""
        meta = manifest(self.spark, self.path)
        chosen = [s for s in meta["segments"] if s["id"] in set(ids)]
        reader = SegmentReader(self.spark, self.path, meta | {"segments": chosen})
        made = self._segment(reader.docs().select("path", "content")) if chosen else None
        segments = [s for s in meta["segments"] if s not in chosen] + ([made] if made else [])
        meta = {"version": meta["version"], "opstamp": meta["opstamp"] + 1, "segments": segments}
        store.write_json(self.spark, f"{self.path}/meta.json", meta)
        return meta


def path_index(reader: SegmentReader) -> DataFrame:
    """``path, segment_idx, local_id`` of each live document; the newest, should a path be there twice."""
    own = reader.docs().join(F.broadcast(reader.segments().select("segment_id", F.col("ord").alias("segment_idx"))), "segment_id")
    newest = Window.partitionBy("path").orderBy(F.desc("segment_idx"), F.desc("local_id"))
    return own.withColumn("r", F.row_number().over(newest)).where("r = 1").select("path", "segment_idx", "local_id")
