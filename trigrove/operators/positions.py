"""Positional postings and proximity of trigrams."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import trigrams as T
from ..sources import store
from .index import indexed_text

#: Format 2 has lists of positions as bytes, format 1 a row of pairs for each trigram and document.
FORMATS = ("trigrove-positions-1", "trigrove-positions-2")
#: Bytes of a row group of lists: each task's lists are sorted, so that a lookup reads the groups and pages that hold its trigram.
LIST_GROUP = 32 << 20


def _bodies(docs: DataFrame) -> DataFrame:
    """``file_id, body`` of the documents that have positions."""
    body = indexed_text(F.col("content"), F.coalesce("name", F.lit("")))
    return docs.where(F.col("content").isNotNull()).select("file_id", body.alias("body")).where(F.instr("body", "\0") == 0)


def positions(docs: DataFrame, compat: bool = False, tris: list[str] | None = None) -> DataFrame:
    """``tri, file_id, byte_offset, rune_offset`` of every trigram (with ``tris`` every one of those) of ``docs(file_id, name, content)``.

    The offsets count from the start of name, line feed, content.  With
    ``compat`` a text ends after its first character beyond ASCII, of which
    only the first byte is seen; there byte and character offsets agree.
    """
    whole = _bodies(docs)
    if not compat:
        return scan.every_position(whole, ["body"], "file_id", tris)
    plain = F.regexp_extract("body", "^[\\x00-\\x7F]*", 0)
    seen = F.concat(F.hex(plain), F.substring(F.hex(F.substring(F.col("body"), F.char_length(plain) + 1, F.lit(1))), 1, 2))
    found = whole.select("file_id", F.posexplode(F.regexp_extract_all(seen, F.lit("(?=(.{6}))(?:..)"), 1)).alias("byte_offset", "tri"))
    found = found if tris is None else found.where(F.col("tri").isin(tris))
    return found.select("tri", "file_id", "byte_offset", F.col("byte_offset").alias("rune_offset"))


def positional_postings(found: DataFrame) -> DataFrame:
    """``tri, file_id, positions``: the positions of a trigram in a document, ascending."""
    return found.groupBy("tri", "file_id").agg(F.sort_array(F.collect_list(F.struct("byte_offset", "rune_offset"))).alias("positions"))


def near(a: Column, b: Column, k: int) -> Column:
    """Some position of each of two arrays are within ``k`` characters, in either order."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x["rune_offset"] - y["rune_offset"]) <= k))


def proximity_search(postings: DataFrame, tri_a: str, tri_b: str, k: int) -> DataFrame:
    """Ids of the documents in which two trigrams come within ``k`` characters, ascending."""
    a = postings.where(F.col("tri") == tri_a.upper()).select("file_id", F.col("positions").alias("pa"))
    b = postings.where(F.col("tri") == tri_b.upper()).select("file_id", F.col("positions").alias("pb"))
    return a.join(b, "file_id").where(near(F.col("pa"), F.col("pb"), k)).select("file_id").orderBy("file_id")


def proximity_pairs(postings: DataFrame, tri_a: str, tri_b: str, k: int) -> DataFrame:
    """``file_id, rune_a, rune_b`` of every pair of positions within ``k`` characters."""
    a = postings.where(F.col("tri") == tri_a.upper()).select("file_id", F.col("positions").alias("pa"))
    b = postings.where(F.col("tri") == tri_b.upper()).select("file_id", F.col("positions").alias("pb"))
    pairs = F.flatten(F.transform("pa", lambda x: F.transform(F.filter("pb", lambda y: F.abs(x["rune_offset"] - y["rune_offset"]) <= k), lambda y: F.struct(x["rune_offset"].alias("rune_a"), y["rune_offset"].alias("rune_b")))))
    return a.join(b, "file_id").select("file_id", F.explode(pairs).alias("p")).select("file_id", "p.rune_a", "p.rune_b")


def rune_maps(docs: DataFrame) -> DataFrame:
    """``file_id, samples``: byte offset of every 100th character of the indexed text."""
    return docs.select("file_id", T.rune_samples(indexed_text(F.col("content"), F.coalesce("name", F.lit("")))).alias("samples"))


def extract_positions(file_id: int, data: bytes) -> list[tuple[str, int, int]]:
    """``(tri, byte_offset, rune_offset)`` of one text on the driver, under the admission rules of an indexed text."""
    if b"\0" in data:
        raise ValueError("the text holds a zero byte")
    if max(map(len, data.split(b"\n"))) > T.MAX_LINE:
        raise ValueError("a line of the text is too long")
    out, rune = [], -1
    for i in range(len(data) - 2):
        rune += data[i] & 0xC0 != 0x80
        out.append((data[i : i + 3].hex().upper(), i, rune))
    if len({t for t, _, _ in out}) > T.MAX_TRIGRAMS:
        raise ValueError("the text has too many trigrams")
    return out


def rune_to_byte_offset(data: bytes, rune: int) -> int:
    """Byte offset of a character of a text; the text's length for characters beyond its end."""
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    return starts[rune] if rune < len(starts) else len(data)


def _read(lists: DataFrame, meta: dict) -> DataFrame:
    """``tri, file_id, positions`` of stored lists; where ids are repeated, all positions of one are in one row."""
    pairs = F.transform("places", lambda at, i: F.struct(at.alias("byte_offset"), (at - F.coalesce(F.get("drifts", i), F.lit(0))).alias("rune_offset")))
    rows = scan.places(lists, "file_id").select("tri", F.col("file_id").cast(meta["ids"]).alias("file_id"), pairs.alias("positions"))
    if not meta["repeated"]:
        return rows
    return rows.groupBy("tri", "file_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


@dataclass
class PositionalIndex:
    """``docs(file_id, name)``, ``postings(tri, file_id, positions)`` and ``maps(file_id, samples)``.

    ``bodies(file_id, body)`` are the texts of an index that isn't stored,
    ``table`` the lists of a stored one, both where ids are whole numbers, and
    ``meta`` says of what kind these are and whether some are repeated.
    """

    docs: DataFrame
    postings: DataFrame
    maps: DataFrame
    bodies: DataFrame | None = None
    table: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, compat: bool = False) -> PositionalIndex:
        """Index ``docs(file_id, name, content)``; every document keeps its name, whether or not it has postings."""
        listed = not compat and scan.integral(docs, "file_id")
        return cls(docs.select("file_id", "name"), positional_postings(positions(docs, compat)), rune_maps(docs), _bodies(docs) if listed else None)

    def write(self, path: str) -> PositionalIndex:
        spark = self.docs.sparkSession
        meta: dict = {"format": FORMATS[self.bodies is not None]}
        if self.bodies is not None:
            # nothing is shuffled: each task writes the lists of its own documents, about two bytes for a position
            lists = scan.placed(self.bodies, ["body"], "file_id").sortWithinPartitions("tri", "block")
            lists.write.option("parquet.block.size", LIST_GROUP).mode("overwrite").parquet(f"{path}/postings", compression="zstd")
            repeated = not self.bodies.groupBy("file_id").count().where("count > 1").isEmpty()
            meta |= {"ids": dict(self.bodies.dtypes)["file_id"], "repeated": repeated}
        else:
            self.postings.repartitionByRange("tri", "file_id").sortWithinPartitions("tri", "file_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.maps.write.mode("overwrite").parquet(f"{path}/maps")
        store.write_json(spark, f"{path}/positions.json", meta)
        return self.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PositionalIndex:
        meta = store.read_json(spark, f"{path}/positions.json")
        if meta is None or meta.get("format") not in FORMATS:
            raise ValueError(f"no positional index of format {' or '.join(FORMATS)} at {path}")
        docs, postings, maps = (spark.read.parquet(f"{path}/{part}") for part in ("docs", "postings", "maps"))
        if meta["format"] == FORMATS[0]:
            return cls(docs, postings, maps)
        return cls(docs, _read(postings, meta), maps, table=postings, meta=meta)

    def _some(self, *tris: str) -> DataFrame:
        """The postings of some trigrams; of a stored index only their lists are read."""
        asked = F.col("tri").isin([t.upper() for t in tris])
        return self.postings.where(asked) if self.table is None else _read(self.table.where(asked), self.meta)

    @cached_property
    def file_count(self) -> int:
        return self.docs.count()

    @cached_property
    def trigram_count(self) -> int:
        return (self.postings if self.table is None else self.table).select("tri").distinct().count()

    def lookup(self, tri: str) -> DataFrame:
        """``file_id, positions`` of the documents with a trigram."""
        return self._some(tri).select("file_id", "positions")

    def counts(self) -> DataFrame:
        """``tri, files, positions``: how many documents and places each trigram has."""
        if self.table is None or self.meta["repeated"]:
            return self.postings.groupBy("tri").agg(F.count("*").alias("files"), F.sum(F.size("positions")).alias("positions"))
        return self.table.groupBy("tri").agg(F.sum("files").alias("files"), F.sum("n").alias("positions"))

    def names(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.docs, "file_id", "left")

    def rune_map(self, file_id: int) -> list[int] | None:
        """Byte offsets of every 100th character of a document; None for an unknown one."""
        row = self.maps.where(F.col("file_id") == file_id).select("samples").first()
        return row and row["samples"]

    def proximity_search(self, tri_a: str, tri_b: str, k: int) -> DataFrame:
        return proximity_search(self._some(tri_a, tri_b), tri_a, tri_b, k)
