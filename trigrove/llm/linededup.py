"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its LCP intervals.

The corpus is one sequence of lines, in the order of document ids.  Lines
without a word are left out, and so are lines that occur once, because nothing
repeated crosses them.  Round k ranks the prefixes of ``2**k`` lines of all
suffixes, from the ranks of their two halves, in the lines' sort order; prefixes
that occur once drop out, so rounds shrink fast, and they end when no prefix
repeats.

The suffixes with a common prefix of m lines are an LCP interval.  Walking the
rounds backwards, each suffix descends to the deepest interval that also holds
an earlier suffix: that depth is the longest run of lines, starting there, that
occurred before.  Of each interval its first suffix stays represented in the
interval above, so what a later suffix compares itself with is never missing.
Maximal runs of at least ``min_words`` words are deleted from the later copy,
together with the blank lines that follow a deleted line; the first copy stays.

Every table of a round is written to the shared folder.  Exact copies of whole
texts take part once.  Lines are equal if 128 bits of their BLAKE2 digests are,
texts if 128 bits of their SHA-256 are: cryptographic digests, of which no two
different inputs with a common value are known.

Edge cases: a null text stays null, with no lines.  Rows that have equal ids
and texts are one document, cut alike.  Rows without an id come last.  A text
that is deleted whole becomes empty.  Extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, written

#: Words of a repeated run, at least.
MIN_WORDS = 10
_LAST = (1 << 63) - 1


def _full_lines(part: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and words of the lines that have a word."""
    start, end, row = X.lines(part)
    w = X.words(part)
    count = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    full = count > 0
    return start[full], end[full], row[full], count[full]


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in X.texts(batch.column(3)):
            n = len(part.offsets) - 1
            start, end, row, _ = _full_lines(part)
            bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            raw = memoryview(part.data)
            digests = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist()))
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(halves[:, i]))) for i in (0, 1)]
            own = batch.slice(part.first, n)
            yield pa.RecordBatch.from_arrays([*own.columns[:3], *lists], ["d", "t1", "t2", "h1", "h2"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions inside the partition; one is left free after each text, so that runs end with it."""
    own = TaskContext.get().partitionId()
    at = 0
    for batch in batches:
        size = np.diff(np.asarray(batch.column(3).offsets)).astype(np.int64) + 1
        local = at + np.cumsum(size) - size
        at += int(size.sum())
        part = pa.array(np.full(batch.num_rows, own, np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, part, pa.array(local), pa.array(size)], ["d", "t1", "t2", "h1", "h2", "part", "local", "size"])


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """``p, r``: the rank of each row's key in sort order, for keys that occur again."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    # ids that grow along the range-sorted partitions are ranks; the written table fixes them
    ranks = written(again.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")
    return rows.join(ranks, list(keys)).select("p", F.col("rank").alias("r"))


def text_key(text: str) -> list[Column]:
    """Two longs: the first 128 bits of the text's SHA-256."""
    digest = F.sha2(F.col(text), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "t1"), (17, "t2"))]


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``t1, t2, first_d, n_same, runs`` of each distinct text: its maximal runs (first line, lines) that occurred before."""
    source = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("d"), *text_key(text), F.col(text).alias("text"))
    found = source.mapInArrow(_lines_of, "d long, t1 long, t2 long, h1 array<long>, h2 array<long>")
    single = found.groupBy("t1", "t2").agg(F.min(F.struct("d", "h1", "h2")).alias("s"), F.min("d").alias("d"), F.max("d").alias("last"))
    texts = written(single.select("d", "t1", "t2", F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"), "last"), "line-texts")
    placed = texts.select("d", "t1", "t2", "h1", "h2").repartitionByRange("d", "t1").sortWithinPartitions("d", "t1", "t2")
    placed = written(placed.mapInArrow(_placed, "d long, t1 long, t2 long, h1 array<long>, h2 array<long>, part long, local long, size long"), "line-docs")
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("size").alias("n")).collect()}  # a number for each partition
    base, run = {}, 0
    for part in sorted(totals):
        base[part], run = run, run + totals[part]
    starts = docs.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "part long, base long")
    placed = placed.join(F.broadcast(starts), "part").withColumn("g", F.col("base") + F.col("local"))
    lines = placed.select("g", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select((F.col("g") + F.col("i")).alias("p"), "g", "h.h1", "h.h2")
    level = [written(_ranked(lines, "h1", "h2"), "line-level")]
    while True:
        now, step = level[-1], 1 << (len(level) - 1)
        halves = now.join(now.select((F.col("p") - step).alias("p"), F.col("r").alias("r2")), "p")
        after = written(_ranked(halves, "r", "r2"), "line-level")
        if after.isEmpty():
            drop(after)
            break
        level.append(after)
    schema = "p long, m long, c long, own boolean"
    held = docs.sparkSession.createDataFrame([], schema)
    for k in reversed(range(len(level))):
        step = 1 << k
        own = held.where("own")
        # suffixes that no earlier suffix matches yet are in the root interval: depth 0, class -1
        root = level[k].join(own.select("p"), "p", "left_anti").select("p", F.lit(0).cast("long").alias("m"), F.lit(-1).cast("long").alias("c"), F.lit(True).alias("own"), "r")
        deep = held.join(level[k].select(F.col("p").alias("q"), "r"), F.col("p") + F.col("m") == F.col("q")).select("p", "m", "c", "own", "r")
        tried = root.union(deep)
        inner = tried.groupBy("c", "r").agg(F.min("p").alias("f"), F.count("*").alias("n")).where("n > 1").select("c", "r", "f")
        inner = written(inner.withColumn("id", F.monotonically_increasing_id()), "line-intervals")
        hit = written(tried.join(inner, ["c", "r"]).select("p", (F.col("m") + step).alias("m"), "id", "own", "f"), "line-hits")
        named = F.col("id") * 64 + k  # ids are unique in a round
        moved = hit.where("own and p > f").select("p", "m", named.alias("c"), "own")
        carried = hit.where("p = f").select("p", "m", named.alias("c"), F.lit(False).alias("own"))
        stay = own.join(moved.select("p"), "p", "left_anti").select("p", "m", "c", "own")
        before, held = held, written(held.where("not own").union(stay).union(moved).union(carried), "line-depths")
        for old in (inner, hit, *([before] if k < len(level) - 1 else [])):
            drop(old)
    depth = held.where("own").select("p", "m")
    start = lines.select("p", "g").join(depth, "p")
    # a run is maximal unless the run one line before it covers it
    inside = depth.select((F.col("p") + 1).alias("p"), (F.col("m") - 1).alias("covered"))
    start = start.join(inside, "p", "left").where("covered is null or covered < m")
    runs = start.groupBy("g").agg(F.sort_array(F.collect_list(F.struct((F.col("p") - F.col("g")).alias("i"), "m"))).alias("runs"))
    named = placed.select("g", "t1", "t2").join(runs, "g").select("t1", "t2", "runs")
    return texts.select("t1", "t2", F.col("d").alias("first_d"), "last").join(named, ["t1", "t2"], "left").where("runs is not null or last > first_d").select("t1", "t2", "first_d", "runs")


def _cut(text: str, runs: list[dict[str, int]], whole: bool, min_words: int) -> tuple[str, int, int]:
    """The text without its runs, its lines with a word, and how many of them went."""
    lines = text.split("\n")
    words = [len(line.encode().split()) for line in lines]
    full = [i for i, n in enumerate(words) if n]
    sums = np.concatenate([[0], np.cumsum([words[i] for i in full])])
    gone = np.zeros(len(full) + 1, np.int64)
    for run in [{"i": 0, "m": len(full)}] if whole else runs:
        if sums[run["i"] + run["m"]] - sums[run["i"]] >= min_words:
            gone[run["i"]] += 1
            gone[run["i"] + run["m"]] -= 1
    cut = np.cumsum(gone[:-1]) > 0
    if not cut.any():
        return text, len(full), 0
    out, after = [], False
    at = 0
    for line, n in zip(lines, words):
        if n:
            after = bool(cut[at])
            at += 1
        if not after:
            out.append(line)
    return "\n".join(out), len(full), int(cut.sum())


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs deleted, ``n_lines`` and ``n_removed``."""
    info = repeated_runs(docs, text, key)
    added = ["n_lines", "n_removed"]
    carried = [c for c in docs.columns if c not in (text, *added)]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]
    out = [*safe, "__text", *added]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, first, runs, body = (c.to_pylist() for c in batch.columns[-4:])
            plain = np.zeros(batch.num_rows, np.int64)
            for part in X.texts(batch.column(batch.num_columns - 1)):
                row = _full_lines(part)[2]
                plain[part.first : part.first + len(part.offsets) - 1] = np.bincount(row, minlength=len(part.offsets) - 1)
            removed = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                if first[i] is not None and body[i] is not None:
                    body[i], _, removed[i] = _cut(body[i], runs[i] or [], d[i] > first[i], min_words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(body, pa.string()), pa.array(plain), pa.array(removed)], out)

    keyed = docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("__d"), F.col(text).alias("__text"), *(c.alias(f"__t{i}") for i, c in enumerate(text_key(text))))
    info = info.select(F.col("t1").alias("__t0"), F.col("t2").alias("__t1"), F.col("first_d").alias("__first"), F.col("runs").alias("__runs"))
    joined = keyed.join(info, ["__t0", "__t1"], "left").select(*safe, "__d", "__first", "__runs", "__text")
    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["__text string", "n_lines long", "n_removed long"])
    return joined.mapInArrow(apply, schema).toDF(*carried, text, *added)
