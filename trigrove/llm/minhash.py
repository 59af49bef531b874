"""Near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find grouping.

A text's set holds its distinct two-word shingles (64-bit hashes of a mixing
hash over the words' bytes).  SuperMinHash draws one permutation of the
signature's slots per shingle, rank by rank; a shingle stops as soon as its rank
exceeds every slot's present value, so most stop after a few ranks.  Texts with
the same sequence of words, by a 128-bit BLAKE2 digest, collapse into one node
before banding.  Inside a bucket each node is first checked against a single hub.

Where those links leave a bucket in several components, its nodes are compared
across components by an exact prefix filter: each set is put in one order of
shingles for all (rarest first, by a counted table of bounded size), and two
sets that are similar enough share a shingle among the first quarter of each.
So pages of one template, which share most of their shingles without being
similar enough, meet in few pairs and not all with all, and no bucket's pairs
are enumerated.  Sizes and places of the shared shingle rule out further pairs.

Every link is confirmed on the full sets, so there are no false links.  A link
at exactly the threshold is missed if all bands differ:
``(1 - 0.75**ROWS) ** BANDS``, 2e-6.

Edge cases: a null or empty text has the empty set and is linked with nothing
(``component_id`` its own id).  One word is a set of one.  Rows with a null id
get statistics and a null component.  Rows are grouped
by their texts, so rows with an equal id and different texts may differ; where
such an id is the smallest of both texts, the set that sorts first stands for it.
An empty table gives an empty result.  Of the input only the key and the text
are read, so extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, sieved, written
from .components import connected_components

BANDS, ROWS = 48, 5
SLOTS = BANDS * ROWS
#: Link where 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Counters of the table that orders shingles: one for this many shingles, within these bounds (a power of two).
SHINGLES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 256, 1 << 12, 1 << 20
#: Sets that hold one shingle and are compared by one task, about.
TOKEN_ROWS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(part: X.Texts, w: X.Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted inside each row, and ``rows + 1`` bounds."""
    w = X.words(part, lower=True) if w is None else w
    n = len(part.offsets) - 1
    if not len(w.row):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(w.row[:-1] == w.row[1:])
    lone = w.bounds[:-1][np.diff(w.bounds) == 1]
    value = np.concatenate([X.mix(w.hash[at] * _GOLD + w.hash[at + 1]), X.mix(w.hash[lone] + np.uint64(1))])
    row = np.concatenate([w.row[at], w.row[lone]])
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def word_digests(part: X.Texts, w: X.Words) -> np.ndarray:
    """``rows x 2`` longs: a digest of each row's lower-cased words with single spaces between them."""
    keep = ~X.SPACE[part.data]
    gap = w.end[:-1][w.row[:-1] == w.row[1:]]
    keep[gap] = True
    body = X.LOWER[part.data]
    body[gap] = 32
    raw = memoryview(body[keep])
    ends = X.counted_prefix(keep)[part.offsets].tolist()
    return np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])), np.int64).reshape(-1, 2)


def signatures(value: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: ``rows x slots`` of ``rank << 24 | fraction``; rows with an empty set keep the maximum."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    best = np.full((n, slots), 0xFFFFFFFF, np.uint32)
    flat = best.reshape(-1)
    swap: np.ndarray | None = None
    for j in range(slots):
        draw = X.mix(value + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((draw >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if swap is None:
                swap = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(value), 1))
                one = np.arange(len(value))
                swap[one, first] = 0
                swap[one, 0] = first
            one = np.arange(len(value))
            slot = swap[one, k].astype(np.int64)
            swap[one, k] = swap[:, j]
        np.minimum.at(flat, row * slots + slot, (np.uint32(j) << np.uint32(24)) | (draw & np.uint64(0xFFFFFF)).astype(np.uint32))
        worst = best.max(1) >> 24
        going = (worst > j)[row]
        if not going.all():
            value, row = value[going], row[going]
            if not len(value):
                break
            if j == 0:
                first = first[going]
            if swap is not None:
                swap = swap[going]
    return best


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = best[:, : bands * rows].reshape(len(best), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for i in range(rows):
        key = X.mix(key * np.uint64(3) + parts[:, :, i])
    return key.view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for part in X.texts(batch.column(1)):
            w = X.words(part, lower=True)
            value, bounds = shingle_sets(part, w)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            digest = word_digests(part, w)
            keys = band_keys(signatures(value, np.append(bounds[:-1][full], len(value)))) if len(full) else np.zeros((0, BANDS), np.int64)
            out.append((n, digest[:, 0], digest[:, 1], keys.ravel(), np.where(n > 0, BANDS, 0)))
        if out:
            n, k1, k2, keys, size = (np.concatenate(x) for x in zip(*out))
            lists = _lists(keys, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(k1), pa.array(k2), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in X.texts(batch.column(1)):
            value, bounds = shingle_sets(part)
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], _lists(value.view(np.int64), bounds)], ["node", "shingles"])
            at += n


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(F.lit(100) * common >= F.lit(SIMILAR) * (F.size("x") + F.size("y") - common)).select("a", "b")


def _counters(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each hash bucket are over all ``sets(shingles)``, in eighths of an octave."""
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    size = LEAST_COUNTERS
    while size < min(MOST_COUNTERS, total // SHINGLES_A_COUNTER):
        size *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().view(np.uint64)
            held += np.bincount((flat & np.uint64(size - 1)).astype(np.int64), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["at", "n"])

    found = sets.select("shingles").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # MOST_COUNTERS rows
    out = np.zeros(size, np.uint16)
    out[found["at"].to_numpy()] = np.log2(found["n"].to_numpy()) * 8 + 1
    return out


def _prefixes(sets: DataFrame, counters: np.ndarray) -> DataFrame:
    """``token, node, c, n, place``: of each set the rarest shingles, one of which any similar set has among its own."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            value = lists.flatten().to_numpy().view(np.uint64)
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, counters[(value & np.uint64(len(counters) - 1)).astype(np.int64)], row))
            place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)  # the order keeps rows together
            used = place < (n - (SIMILAR * n + 99) // 100 + 1)[row]
            own = row[used]
            arrays = [pa.array(value[order][used].view(np.int64)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(place[used].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["token", "node", "c", "n", "place"])

    return sets.select("node", "c", "shingles").mapInArrow(prefix, "token long, node long, c long, n int, place int")


def _across(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``sets(node, c, shingles)`` with different ``c`` that may be similar enough; none that is, is missing."""
    prefixes = found = written(_prefixes(sets, _counters(sets)), "minhash-prefixes")
    shared = found.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo != hi")
    # a pair's sizes differ by a third at most, so the smaller set looks in its own step of sizes and in the next one;
    # a token that many sets hold is dealt to several tasks, each of which sees all its smaller sets
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / SIMILAR)) + 1e-9)
    found = found.join(shared.select("token", F.ceil(F.col("k") / TOKEN_ROWS).alias("deals")), "token").withColumn("step", step)
    a = found.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).withColumn("step", F.explode(F.array("step", F.col("step") + 1))).alias("a")
    b = found.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals"))).alias("b")
    least = (F.col("a.n") + F.col("b.n")) * F.lit(SIMILAR)  # of (100 + SIMILAR) times the common shingles
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))  # as a pair's first common shingle
    allowed = (F.lit(100) * F.col("a.n") >= F.lit(SIMILAR) * F.col("b.n")) & (F.lit(100 + SIMILAR) * most >= least)
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.step") == F.col("b.step")) & (F.col("a.deal") == F.col("b.deal"))
    pairs = a.join(b, same & smaller & (F.col("a.c") != F.col("b.c")) & allowed)
    pairs = written(pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "minhash-pairs")
    drop(prefixes)
    return pairs


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_spanning_links`` of every row.

    ``n_spanning_links`` counts the confirmed links of the row's set that the grouping
    used, not all near duplicates of the row; ``kept`` marks the smallest id of each group.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    described = written(source.mapInArrow(_describe, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "minhash-bands")
    rows = written(described.drop("bands"), "minhash-rows")
    # rows with equal words become one node, named by their smallest id; partial aggregation absorbs groups of copies
    same = ["k1", "k2", "n_shingles"]
    nodes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"))
    banded = described.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "bands")).alias("s"))
    band = banded.select(F.col("s.doc_id").alias("node"), F.explode("s.bands").alias("key")).repartition("key")  # once for both sides of the join
    shared = band.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last")
    member = written(band.join(shared.select("key", "hub"), "key"), "minhash-members")
    drop(described)
    # first each node against the hub with which it shares most buckets
    first = member.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    first = first.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("h"))).alias("s")).select(F.col("node").alias("a"), (-F.col("s.h")).alias("b"))
    first = written(first, "minhash-first")
    wanted = written(member.select("node").distinct(), "minhash-wanted")
    fetched = sieved(source, F.col("doc_id"), wanted).join(wanted.withColumnRenamed("node", "doc_id"), "doc_id")
    sets = written(fetched.mapInArrow(_sets, "node long, shingles array<long>").groupBy("node").agg(F.min("shingles").alias("shingles")), "minhash-sets")
    links = written(_verified(first, sets), "minhash-links")
    groups = connected_components(links)
    # then the nodes of the buckets that are still in several components
    placed = written(member.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")), "minhash-placed")
    drop(member)
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    split = written(sets.join(placed.join(mixed, "key").select("node", "c").distinct(), "node"), "minhash-split")
    for old in (sets, placed, wanted):
        drop(old)
    across = _across(split)
    found = across.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(_verified(found, split), "minhash-links")
    for old in (split, across, first):
        drop(old)
    used = links.union(more)
    groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    counts = used.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_spanning_links"))
    classes = nodes.join(groups, "node", "left").join(counts, "node", "left")
    classes = classes.select(*same, F.coalesce("component", "node").alias("c"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    out = rows.join(classes, same, "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("c")), F.col("doc_id")).alias("component_id"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
