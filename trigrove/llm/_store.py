"""Tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder


#: Spark's setting by which the shuffle files of an execution go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a sieve for each key, and the most of all (4 MB, in words of 64 bits).
BITS_A_KEY, MOST_BITS = 16, 1 << 25


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """``df`` written as a shared Parquet table and read back: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def sieved(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Those ``rows`` whose long ``key`` may be in the one column of ``keys``, so that a join with them moves little else.

    A table of bits, of bounded size, is broadcast: no row with such a key is
    missing, and of the others few pass (with very many keys all do).
    """
    name = keys.columns[0]
    bits = 1 << 16
    wanted = keys.count() * BITS_A_KEY
    while bits < min(MOST_BITS, wanted):
        bits *= 2

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))

    bit = F.expr("shiftleft(1L, cast(__place % 64 as int))")
    words = keys.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("__place")).select(F.floor(F.col("__place") / 64).alias("__word"), bit.alias("__bit"))
    words = words.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    placed = rows.withColumn("__place", place(key)).withColumn("__word", F.floor(F.col("__place") / 64))
    found = placed.join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return found.select(*rows.columns)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
