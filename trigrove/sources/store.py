"""Small JSON files and fixed tables on any Hadoop file system."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Replace a file atomically: write beside it, then rename."""
    final, fs = _path(spark, path)
    temporary, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.hsync() if hasattr(out, "hsync") else None
    out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    context.rename(temporary, final, flags)


def read_json(spark: SparkSession, path: str) -> Any | None:
    """The value, or None where there is no file."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, a temporary one, for ``local`` masters only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trigrove-")
    return folder.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """The frame as a written table, so that ids made by it stay the same; in the session's checkpoint folder."""
    path = f"{shared_folder(df.sparkSession)}/fixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
