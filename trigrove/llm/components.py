"""Connected components of an edge table: union-find inside partitions, then large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find: each node that isn't the smallest of its component, with that smallest node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:  # the forest so far has fewer edges than nodes, so memory follows the nodes of a partition
        waiting.append(batch)
        size += batch.num_rows
        if size > max(1 << 16, len(a)):  # however small the batches, all the work stays in proportion to the edges
            a, b = forest(*(np.concatenate([x, *(w.column(i).to_numpy() for w in waiting)]) for i, x in enumerate((a, b))))
            waiting, size = [], 0
    a, b = forest(*(np.concatenate([x, *(w.column(i).to_numpy() for w in waiting)]) for i, x in enumerate((a, b))))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)`` (longs) but the components' smallest nodes.

    Null ends, loops and repeated edges are ignored.  Every round is written to
    the shared folder, so no lineage grows; the rounds are logarithmic in the
    length of the longest chain.
    """
    clean = edges.where("a is not null and b is not null and a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = written(clean.mapInArrow(_contract, "a long, b long"), "cc")  # a > b: a star around each partition's roots
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large-star: of each node, its larger neighbours to its smallest one
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        # small-star: of each node, itself and its smaller neighbours to the smallest one
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        pairs = large.join(small, "x")
        after = pairs.select(F.col("y").alias("a"), F.col("m").alias("b")).union(pairs.select(F.col("x").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        after = written(after, "cc")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        drop(now)
        now = after
        # stars only: nothing moves any more
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
