"""Folders as document sources, and what changed between two scans of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import TrigramIndex, dense_ids
from . import store
from .segments import SegmentWriter

_STATE = "path string, mtime timestamp, size long"


def scan(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``path, mtime, size`` of the regular files below the folders; folders that don't exist are skipped.

    Contents aren't read: the columns are file metadata.
    """
    found = [f for f in folders if "://" in f or Path(f).is_dir()]
    if not found:
        return spark.createDataFrame([], _STATE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def contents(spark: SparkSession, folders: list[str], limit: int | None = None) -> DataFrame:
    """``path, content`` (binary) of the files; with ``limit`` only of those of at most so many bytes."""
    found = [f for f in folders if "://" in f or Path(f).is_dir()]
    if not found:
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    return (files if limit is None else files.where(F.col("length") <= limit)).select("path", "content")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change_type`` (added, modified, deleted) from one state to the next."""
    a = old.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("before"))
    b = new.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("after"))
    joined = a.join(b, "path", "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(~(F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1"))), "modified")
    return joined.select("path", kind.alias("change_type")).where("change_type is not null")


@dataclass
class FileTracker:
    """The last indexed state of some folders, kept in a folder of its own.

    ``max_bytes`` leaves larger files out of what is indexed; by default none is.
    """

    spark: SparkSession
    path: str
    folders: list[str] = field(default_factory=list)
    max_bytes: int | None = None

    def add_directory(self, folder: str) -> None:
        if folder not in self.folders:
            self.folders.append(folder)

    def _version(self) -> int:
        return (store.read_json(self.spark, f"{self.path}/state.json") or {"version": 0})["version"]

    def state(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/state-{version}") if version else self.spark.createDataFrame([], _STATE)

    def pending(self) -> DataFrame:
        """What changed since the state was marked, over all folders together."""
        return changes(self.state(), scan(self.spark, self.folders))

    def has_pending_changes(self) -> bool:
        return not self.pending().isEmpty()

    def file_count(self) -> int:
        return self.state().count()

    def snapshot(self) -> DataFrame:
        """The present scan, written as the next state; it becomes the state when it is marked."""
        path = f"{self.path}/state-{self._version() + 1}"
        scan(self.spark, self.folders).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_STATE).parquet(path)

    def mark_indexed(self, snapshot: DataFrame | None = None) -> None:
        """Make a snapshot (a new one, if not given) the state; deleted files leave it.

        What changed after the snapshot differs from the state, and so is pending.
        """
        if snapshot is None:
            self.snapshot()
        store.write_json(self.spark, f"{self.path}/state.json", {"version": self._version() + 1})

    def rebuild(self, target: str) -> TrigramIndex:
        """Index all present files anew, with ids in path order, and mark them."""
        seen = self.snapshot()
        docs = dense_ids(contents(self.spark, self.folders, self.max_bytes), "path").select("file_id", F.col("path").alias("name"), "content")
        index = TrigramIndex.build(docs, binary=True).write(target)
        self.mark_indexed(seen)
        return index

    def apply(self, writer: SegmentWriter) -> dict:
        """Bring a segment index up to date with a snapshot of the folders, and mark that."""
        seen = self.snapshot()
        changed = changes(self.state(), seen)
        fresh = contents(self.spark, self.folders, self.max_bytes).join(changed.where("change_type != 'deleted'"), "path", "left_semi")
        meta = writer.apply(fresh.select("path", F.col("content").cast("string").alias("content")), changed.select("path"))
        self.mark_indexed(seen)
        return meta
