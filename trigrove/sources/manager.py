"""Named indexes in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import data_folder, sanitised
from . import store
from .segments import SegmentReader, SegmentWriter


@dataclass
class IndexManager:
    spark: SparkSession
    root: str = ""

    def __post_init__(self) -> None:
        self.root = self.root or str(data_folder("trigrove") / "indexes")

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{sanitised(name)}"

    def open_writer(self, name: str) -> SegmentWriter:
        return SegmentWriter(self.spark, self.path(name))

    def open_reader(self, name: str) -> SegmentReader:
        return SegmentReader.open(self.spark, self.path(name))

    def rebuild(self, name: str, docs: DataFrame) -> dict:
        """Delete the index and commit ``docs(path, content)`` as its only segment."""
        store.delete(self.spark, self.path(name))
        return self.open_writer(name).apply(docs)
