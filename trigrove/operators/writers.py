"""Writers that take one document at a time, for small corpora and scripts.

They stage rows on the driver and hand them to the table builders; large
corpora go to those builders directly, as DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .fields import FieldIndex
from .index import TrigramIndex
from .positions import PositionalIndex


@dataclass
class IndexWriter:
    """Ids follow the order of the documents that are admitted."""

    spark: SparkSession
    rows: list[tuple[str, str]] = field(default_factory=list)

    def add_file(self, name: str, content: str) -> None:
        self.rows.append((name, content))

    def _docs(self, keep: set[int] | None = None):
        chosen = [r for i, r in enumerate(self.rows) if keep is None or i in keep]
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(chosen)], "file_id long, name string, content string")

    def finish(self, path: str) -> TrigramIndex:
        good = {r["file_id"] for r in TrigramIndex.build(self._docs()).docs.select("file_id").collect()}
        return TrigramIndex.build(self._docs(good)).write(path)


@dataclass
class PositionalIndexWriter(IndexWriter):
    """Every document has an id, whatever it holds."""

    def finish(self, path: str) -> PositionalIndex:  # type: ignore[override]
        return PositionalIndex.build(self._docs()).write(path)


@dataclass
class FieldIndexWriter:
    """Fields are numbered as they are registered, documents as their names first come up."""

    spark: SparkSession
    fields: list[str] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)
    rows: list[tuple[int, str, str, str]] = field(default_factory=list)

    def add_field(self, name: str) -> int:
        if name not in self.fields:
            self.fields.append(name)
        return self.fields.index(name)

    def add_file_field(self, name: str, field_id: int, content: str) -> None:
        if not 0 <= field_id < len(self.fields):
            raise ValueError(f"no field {field_id}")
        self.rows.append((self.names.setdefault(name, len(self.names)), name, self.fields[field_id], content))

    def finish(self, path: str) -> FieldIndex:
        rows = self.spark.createDataFrame(self.rows, "file_id long, name string, field string, content string")
        return FieldIndex.build(rows, self.fields).write(path)
