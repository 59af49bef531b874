"""Byte-level BPE encoding by a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of byte runs.  Each adjacent pair whose bytes have
a rank waits in that rank's bucket; three levels of 64-bit bitmaps mark the
buckets that aren't empty, so find-first-set finds the next rank in three
steps.  Merging changes two neighbouring pairs; entries that a merge outdated
stay in their buckets and are skipped when they come up.  A pre-token of n
bytes costs O(n log n) whatever its length.

Edge cases: null and empty texts have no ids.  Any valid text round-trips.
Repeated rows are encoded alike; an empty table gives an empty result.  Of the
columns that are carried, one that bears the name of a result column (``ids``,
``decoded``) is replaced by it; all others keep their names and values.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._pretokens import Encoder


class RankQueue:
    """Positions by rank; the smallest rank first, the leftmost position first."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks + 64 >> 6)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.bucket.get(rank)
        if held:
            heappush(held, position)
            return
        if held is None:
            self.bucket[rank] = [position]
        else:
            held.append(position)
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """Rank and position; (-1, -1) if empty."""
        if not self.top:
            return -1, -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | ((w := self.mid[a]) & -w).bit_length() - 1
        rank = b << 6 | ((w := self.low[b]) & -w).bit_length() - 1
        held = self.bucket[rank]
        position = heappop(held)
        if not held:
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.mid[a] &= ~(1 << (b & 63))
                if not self.mid[a]:
                    self.top &= ~(1 << a)
        return rank, position


class Bpe:
    """A vocabulary of ``bytes -> rank``; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        size = max(ranks.values()) + 1
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.encoder = Encoder(lambda pieces: [self.piece(p) for p in pieces])

    @classmethod
    def load(cls, path: str) -> Bpe:
        """A file of lines ``base64 rank``."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)})

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        part: list[bytes] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [-1] * n  # the rank under which a position's pair waits now
        queue, push = self.queue, self.queue.push
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                waits[i] = rank
                push(rank, i)
        while True:
            rank, i = queue.pop()
            if i < 0:
                break
            if waits[i] != rank:
                continue  # stale
            j = after[i]
            merged = part[i] = part[i] + part[j]
            waits[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                again = ranks.get(merged + part[k])
                waits[i] = -1 if again is None else again
                if again is not None:
                    push(again, i)
            else:
                waits[i] = -1
            h = before[i]
            if h >= 0:
                again = ranks.get(part[h] + merged)
                waits[h] = -1 if again is None else again
                if again is not None:
                    push(again, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the end of each id's bytes."""
        size = self.sizes[ids]
        return self.bytes[X.spread(self.starts[ids], size)], np.cumsum(size)


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary at ``path``, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe.load(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``ids`` of each row's whole text, with the columns ``keep``."""
    carried = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.texts(batch.column(batch.num_columns - 1)):
                ids, bounds = loaded(path).encoder.rows(part)
                own = batch.slice(part.first, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], [*safe, "ids"])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["ids array<int>"])
    return docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(text).alias("__text")).mapInArrow(apply, schema).toDF(*carried, "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The frame with ``decoded``, the text of its ids, instead of them."""
    carried = [c for c in encoded.columns if c not in (ids, "decoded")]
    types = dict(encoded.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            bounds = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values)[bounds[0] : bounds[-1]]
            body, ends = loaded(path).decode(flat)
            at = np.concatenate([[0], ends])[bounds - bounds[0]]
            text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text.cast(pa.string())], [*safe, "decoded"])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["decoded string"])
    return encoded.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.coalesce(F.col(ids), F.expr("array()").cast("array<int>")).alias("__ids")).mapInArrow(apply, schema).toDF(*carried, "decoded")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, then decoded from the ids."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.texts(batch.column(1)):
                bpe = loaded(path)
                ids, bounds = bpe.encoder.rows(part)
                body, ends = bpe.decode(ids)
                at = np.concatenate([[0], ends])[bounds].tolist()
                raw, text_ = memoryview(ids.astype("<u4").tobytes()), memoryview(body.tobytes())
                b = bounds.tolist()
                rows = range(len(b) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.first : part.first + len(rows)],
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(raw[4 * b[i] : 4 * b[i + 1]]).hexdigest() for i in rows]),
                        pa.array([hashlib.sha256(text_[at[i] : at[i + 1]]).hexdigest() for i in rows]),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(apply, schema)
