"""Structured Streaming into a segment index.

A file source finds new files; each micro-batch, debounced by the trigger's
interval, becomes one commit of upserts.  File sources never report deletions:
those come from :meth:`trigrove.sources.files.FileTracker.apply`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.segments import SegmentWriter

BATCH_WINDOW = "1 second"


def watch(spark: SparkSession, folder: str, max_files: int = 10_000) -> DataFrame:
    """A stream ``path, content, mtime`` of the files that appear below a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    return stream.select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"))


def latest(batch: DataFrame) -> DataFrame:
    """One row a path: the newest; of rows of one time a deletion, else the greatest content."""
    newest = F.struct("mtime", F.col("content").isNull(), "content")
    return batch.groupBy("path").agg(F.max_by("content", newest).alias("content"))


def ingest(stream: DataFrame, writer: SegmentWriter, checkpoint: str, window: str | None = BATCH_WINDOW) -> StreamingQuery:
    """Upsert a stream ``path, content, mtime`` (null content: delete); without ``window`` all that is there, then stop."""

    def upsert(batch: DataFrame, _: int) -> None:
        rows = latest(batch)
        writer.apply(rows.where("content is not null"), rows.select("path"))

    sink = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (sink.trigger(processingTime=window) if window else sink.trigger(availableNow=True)).start()
