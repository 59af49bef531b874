"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

A document's ids (and a closing id) are cut into full pieces and one rest.
Only the histogram of piece lengths, at most ``limit`` numbers, reaches the
driver: lengths are placed longest first, each time into the shortest pattern
that the histogram has produced so far, and a pattern's count is split where
only some of it is used.  A pattern is a list of lengths with a count.  Pieces
find their place by their rank among the pieces of their length; ranks are
counted in buckets, so a length that a third of all pieces share is ranked by
many tasks.

Edge cases: a null or empty text is its closing id alone.  Repeated rows are
packed as often as they occur, in any order among themselves.  Without rows
there are no sequences.  Of the input only the key and the text are read, so
extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._pretokens import Encoder
from ._store import written

LIMIT = 1024
#: Pieces that one task ranks, about.
BUCKET_ROWS = 100_000


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The tokenizer at ``path``; it meets each pre-token once in each Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    return Encoder(encode)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``start, length, ids_crc32, doc_tokens`` of each piece of each row."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in X.texts(batch.column(1)):
                ids, bounds = encoder(path).rows(part)
                ids = np.insert(ids, bounds[1:], end).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                count = -(-sizes // limit)
                row = np.repeat(np.arange(len(sizes)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * limit
                length = np.minimum(sizes[row] - start, limit)
                raw = memoryview(ids.tobytes())
                lo = (bounds[row] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist())]
                own = batch.column(0).take(pa.array(row + part.first))
                yield pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row])], names)

    return docs.select(key, text).mapInArrow(apply, f"{key} {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Shortest-pack-first: ``(lengths, count)`` of each pattern."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by filled length
    heights: set[int] = set()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[list[int], int]] = []
        while left:
            fits = [h for h in heights if h + length <= limit]
            if not fits:
                placed.append(([length], left))
                break
            h = min(fits)
            lengths, count = open_[h].pop()
            used = min(count, left)
            if used < count:
                open_[h].append((lengths, count - used))
            if not open_[h]:
                heights.discard(h)
            placed.append(([*lengths, length], used))
            left -= used
        for lengths, count in placed:  # after the length is done, so that it may stack on itself below
            open_.setdefault(sum(lengths), []).append((lengths, count))
            heights.add(sum(lengths))
        if placed and len(placed[-1][0]) == 1 and 2 * length <= limit:
            # a length that met no open pattern stacks on itself
            lengths, count = open_[length].pop()
            if not open_[length]:
                heights.discard(length)
            fold = limit // length
            for size, n in ((fold, count // fold), (count % fold, 1 if count % fold else 0)):
                if n:
                    open_.setdefault(size * length, []).append(([length] * size, n))
                    heights.add(size * length)
    return [p for h in sorted(open_, reverse=True) for p in open_[h]]


def slots(found: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: from rank ``first`` on, to sequences from ``base`` on, at ``offset``."""
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    used: dict[int, int] = {}
    for lengths, count in found:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), base, offset, count))
            used[length] = used.get(length, 0) + count
            offset += length
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "base": table[:, 2], "offset": table[:, 3], "first": table[:, 1]}


def pack(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each piece with its ``sequence_id`` and its ``offset`` there."""
    cut = written(pieces(docs, path, limit, text=text, key=key), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(patterns(histogram, limit))
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    own = cut.withColumn("__bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)))
    sizes = own.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy(key, "start", "ids_crc32")
    ranked = own.withColumn("__rank", F.row_number().over(inside) - 1).join(sizes, ["length", "__bucket"])
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(where["key"], (length << 48) + rank, "right") - 1
            sequence = where["base"][at] + rank - where["first"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(where["offset"][at])], names)

    schema = f"{key} {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*names[:5], (F.col("__rank") + F.col("__before")).alias("r")).mapInArrow(place, schema)
