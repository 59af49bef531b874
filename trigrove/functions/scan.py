"""Trigrams and admission of whole Arrow batches, in numpy passes over their byte buffers.

Every function takes the texts of a frame as one or more columns that are
joined by line feeds.  A text of any size is scanned in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from . import codecs
from . import trigrams as T

#: Bytes of text that are scanned at once; a longer text is scanned alone, in pieces.
RUN_BYTES = 1 << 18
#: Rows that are scanned at once, so that a row and a trigram fit in 32 bits.
RUN_ROWS = 1 << 8
#: Bytes of an Arrow batch that a worker is sent: it holds several copies of it, whatever the table's size.
BATCH_BYTES = 2 << 20
#: Postings that a task gathers before it sends them on as lists.
LIST_POSTINGS = 1 << 21
#: Positions that a task gathers so.
LIST_POSITIONS = 1 << 20
#: A list holds ids that agree but for these last bits, so that each takes two bytes.
BLOCK_BITS = 16
_LOW = (1 << BLOCK_BITS) - 1
_MID = 1 << BLOCK_BITS - 1
_SHORTS = pa.list_(pa.field("element", pa.int16(), nullable=False))
_HEX = np.frombuffer("".join(f"{i:02X}" for i in range(256)).encode(), np.uint8).reshape(256, 2)
_HEX4 = np.frombuffer("".join(f"{i:04X}" for i in range(1 << 16)).encode(), np.uint8).reshape(1 << 16, 4)


class Run(NamedTuple):
    """Some rows: their bytes, one after the other, ``rows + 1`` offsets, and the first row's place in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def joined(columns: list[pa.Array]) -> pa.Array:
    parts = [c.cast(pa.large_binary()) for c in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b"\n", pa.large_binary()))


def runs(texts: pa.Array) -> Iterator[Run]:
    """The rows in runs of about :data:`RUN_BYTES`; null counts as empty."""
    texts = pc.fill_null(texts, b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, min(at + RUN_ROWS, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1))
        yield Run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def codes(data: np.ndarray) -> np.ndarray:
    """The 24-bit number of the trigram at each byte but the last two."""
    wide = data.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def distinct(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each row's distinct trigrams, in the order of row and code."""
    if len(run.data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    if run.rows == 1:
        seen = np.zeros(1 << 24, bool) if len(run.data) > RUN_BYTES else None
        if seen is None:
            found = np.unique(codes(run.data))
        else:
            for at in range(0, len(run.data), RUN_BYTES):
                if len(piece := run.data[at : at + RUN_BYTES + 2]) > 2:
                    seen[codes(piece)] = True
            found = np.flatnonzero(seen).astype(np.int32)
        return np.zeros(len(found), np.int64), found
    row = np.repeat(np.arange(run.rows, dtype=np.uint32), np.diff(run.offsets))
    key = np.sort((row[:-2] << 24 | codes(run.data).view(np.uint32))[row[:-2] == row[2:]])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> 24).astype(np.int64), (key & 0xFFFFFF).astype(np.int32)


def _pairs() -> np.ndarray:
    a, b = np.arange(256)[:, None], np.arange(256)[None]
    return np.where(a < 0x80, (b < 0x80) | (b >= 0xC0) & (b < 0xF8), np.where(a < 0xC0, b < 0xF8, (a < 0xF8) & (b >= 0x80) & (b < 0xC0)))


_PAIRS = _pairs()


def fits(run: Run, row: np.ndarray, binary: bool) -> np.ndarray:
    """Of each row, whether it keeps the rules of :func:`trigrove.functions.trigrams.admitted`; ``row``: of its distinct trigrams."""
    data, offsets, n = run.data, run.offsets, run.rows
    ok = (np.diff(offsets) <= T.MAX_BYTES) & (np.bincount(row, minlength=n) <= T.MAX_TRIGRAMS)
    owner = lambda at: np.searchsorted(offsets, at, "right") - 1
    ok[owner(np.flatnonzero(data == 0))] = False
    # a line that a feed closes has a byte less than the last one may have
    breaks = np.flatnonzero(data == 10)
    if len(breaks):
        before = np.concatenate([[-1], breaks[:-1]])
        own = owner(breaks)
        start = np.maximum(before + 1, offsets[own])
        ok[own[breaks - start >= T.MAX_LINE]] = False
    last = np.concatenate([[-1], breaks])[np.searchsorted(breaks, offsets[1:])]
    ok &= offsets[1:] - np.maximum(last + 1, offsets[:-1]) <= T.MAX_LINE
    if binary and len(data) > 2:
        at = np.flatnonzero(~_PAIRS[data[:-1], data[1:]]) + 1  # the second byte of each bad pair
        own = owner(at)
        ok[own[at - offsets[own] >= 2]] = False
    return ok


def hex_codes(code: np.ndarray) -> pa.Array:
    """Six hexadecimal digits of each code."""
    digits = np.empty((len(code), 6), np.uint8)
    digits[:, :4] = _HEX4[code >> 8]
    digits[:, 4:] = _HEX[code & 0xFF]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(0, 6 * len(code) + 1, 6, dtype=np.int32)), pa.py_buffer(digits))


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, in whose session workers get batches of at most :data:`BATCH_BYTES`; the setting stays, since rows are computed later."""
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return rows


def _select(rows: DataFrame, texts: list[str], keep: list[str]) -> tuple[DataFrame, list[str], str]:
    columns: list[Column] = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    columns += [F.col(f"`{c}`").alias(f"__t{i}") for i, c in enumerate(texts)]
    types = dict(rows.dtypes)
    names = [f"__k{i}" for i in range(len(keep))]
    return small_batches(rows.select(*columns)), names, ", ".join(f"{n} {types[c]}" for n, c in zip(names, keep))


def _plain(body: Column) -> Column:
    """Of a string, the admission rules but that on the number of its trigrams."""
    size = F.octet_length(body)
    return (size <= T.MAX_BYTES) & (F.instr(body, "\0") == 0) & ((size < T.MAX_LINE) | T.lines_fit(body))


def _few(body: Column) -> Column:
    """Whether a string has no more trigrams than it may."""
    most = T.MAX_TRIGRAMS

    def few(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        found = [pa.array(np.bincount(distinct(run)[0], minlength=run.rows) <= most) for run in runs(texts)]
        return pa.chunked_array(found, pa.bool_()).combine_chunks() if found else pa.array([], pa.bool_())

    long = F.octet_length(body) > most + 2
    return ~long | F.arrow_udf(few, "boolean")(F.when(long, body))


def admitted(rows: DataFrame, texts: list[str], binary: bool = False, limits: bool = True) -> DataFrame:
    """The rows whose joined texts are indexed; with ``limits=False`` all that have one.

    Strings stay in the JVM: only those long enough to have too many trigrams go to a worker, which counts.
    """
    whole = rows
    for c in texts:
        whole = whole.where(F.col(f"`{c}`").isNotNull())
    if not limits:
        return whole
    if not binary and all(dict(rows.dtypes)[c] == "string" for c in texts):
        body = F.concat_ws("\n", *(F.col(f"`{c}`") for c in texts))
        return small_batches(whole).where(_plain(body)).where(_few(body))
    keep = rows.columns
    selected, names, schema = _select(whole, [], keep)
    at = [keep.index(c) for c in texts]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(joined([batch.column(i) for i in at])):
                good = fits(run, distinct(run)[0], binary)
                yield batch.slice(run.first, run.rows).filter(pa.array(good))

    return selected.mapInArrow(apply, schema).toDF(*keep)


def exploded(rows: DataFrame, texts: list[str], keep: list[str], binary: bool = False, limits: bool = True) -> DataFrame:
    """``tri`` and the columns ``keep`` for each distinct trigram of each indexed row; rows with a null text have none."""
    selected, names, schema = _select(rows, texts, keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = joined(batch.columns[len(keep) :])
            there = body.is_valid().to_numpy(zero_copy_only=False)
            for run in runs(body):
                row, code = distinct(run)
                good = there[run.first : run.first + run.rows]
                if limits:
                    good = good & fits(run, row, binary)
                use = good[row]
                row, code = row[use], code[use]
                own = pa.array(row + run.first)
                yield pa.RecordBatch.from_arrays([hex_codes(code), *(c.take(own) for c in batch.columns[: len(keep)])], ["tri", *names])

    return selected.mapInArrow(apply, f"tri string{', ' if schema else ''}{schema}").toDF("tri", *keep)


def _positions(run: Run) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, code, byte and character offset of each trigram of each row; a long text comes in pieces."""
    data, offsets = run.data, run.offsets
    before = 0  # characters that began before the piece
    for at in range(0, len(data), RUN_BYTES):
        piece = data[at : at + RUN_BYTES + 2]
        starts = (piece & 0xC0) != 0x80
        if len(piece) > 2:
            lead = np.cumsum(starts, dtype=np.int32)
            if run.rows == 1:
                row, place = np.zeros(len(piece) - 2, np.int32), np.arange(at, at + len(piece) - 2, dtype=np.int32)
                yield row, codes(piece), place, lead[:-2] + (before - 1)
            else:
                row = np.repeat(np.arange(run.rows, dtype=np.int32), np.diff(offsets))
                inside = row[:-2] == row[2:]
                row = row[:-2][inside]
                first = np.concatenate([[0], lead])[offsets[:-1]].astype(np.int32)
                place = np.arange(len(piece) - 2, dtype=np.int32)[inside] - offsets[:-1].astype(np.int32)[row]
                yield row, codes(piece)[inside], place, lead[:-2][inside] - 1 - first[row]
        before += int(starts[:RUN_BYTES].sum())


def every_position(rows: DataFrame, texts: list[str], key: str, tris: list[str] | None = None) -> DataFrame:
    """``tri, key, byte_offset, rune_offset`` of every trigram (or every one of ``tris``) of the joined texts, whatever their size."""
    selected, names, schema = _select(rows, texts, [key])
    wanted = None if tris is None else np.unique(np.array([int(t, 16) for t in tris], np.int32))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(joined(batch.columns[1:])):
                for row, code, place, rune in _positions(run):
                    if wanted is not None:
                        use = np.isin(code, wanted)
                        row, code, place, rune = row[use], code[use], place[use], rune[use]
                    if len(place):
                        yield pa.RecordBatch.from_arrays([hex_codes(code), batch.column(0).take(pa.array(row + run.first)), pa.array(place), pa.array(rune)], ["tri", names[0], "byte_offset", "rune_offset"])

    return selected.mapInArrow(apply, f"tri string, {schema}, byte_offset int, rune_offset int").toDF("tri", key, "byte_offset", "rune_offset")


def found(rows: DataFrame, texts: list[str], keep: list[str], tris: list[str], limits: bool = True) -> DataFrame:
    """Of :func:`exploded`, the rows of a few trigrams; the texts are strings and stay in the JVM."""
    body = F.concat_ws("\n", *(F.col(f"`{c}`") for c in texts)).cast("binary")
    there = F.array_compact(F.array(*(F.when(F.contains(body, F.lit(bytes.fromhex(t))), F.lit(t)) for t in tris)))
    held = admitted(rows, texts, limits=limits).select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)), there.alias("__there"))
    return held.select(F.explode("__there").alias("tri"), *(f"__k{i}" for i in range(len(keep)))).toDF("tri", *keep)


# --- postings as lists


def integral(rows: DataFrame, key: str) -> bool:
    """Whether ids are whole numbers, as lists need."""
    return dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")


def _list_schema(group: str | None, kind: str, *more: types.StructField) -> types.StructType:
    known = {"tinyint": types.ByteType(), "smallint": types.ShortType(), "int": types.IntegerType(), "bigint": types.LongType()}
    own = [types.StructField("tri", types.StringType())] + ([types.StructField(group, known[kind])] if group else [])
    return types.StructType([*own, types.StructField("block", types.LongType()), types.StructField("offs", types.ArrayType(types.ShortType(), False)), *more])


class _Ranked(NamedTuple):
    """Documents in the order of group and id: their places in that order, and by it their groups, blocks, last bits and where a list ends."""

    rank: np.ndarray
    groups: pa.Array | None
    block: np.ndarray
    null: np.ndarray
    low: np.ndarray
    part: np.ndarray


def _ranked(ids: list[pa.Array], groups: list[pa.Array]) -> _Ranked:
    own = pa.chunked_array(ids).combine_chunks().cast(pa.int64())
    null = own.is_null().to_numpy(zero_copy_only=False)
    number = pc.fill_null(own, 0).to_numpy()
    group = pa.chunked_array(groups).combine_chunks() if groups else None
    by = pc.fill_null(group.cast(pa.int64()), -1).to_numpy() if group is not None else np.zeros(len(number), np.int64)
    order = np.lexsort((number, null, by))
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    number, null, by = number[order], null[order], by[order]
    block = number >> BLOCK_BITS
    part = np.concatenate([[0], np.cumsum((block[1:] != block[:-1]) | (null[1:] != null[:-1]) | (by[1:] != by[:-1]))])
    return _Ranked(rank, group.take(pa.array(order)) if group is not None else None, block, null, ((number & _LOW) - _MID).astype(np.int16), part)


def _shorts(starts: np.ndarray, total: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), pa.array(values), type=_SHORTS)


def _lists(code: np.ndarray, owner: np.ndarray, docs: _Ranked) -> list[pa.Array]:
    """Columns ``tri, group, block, offs`` of some postings."""
    key = np.sort(code.astype(np.uint64) << np.uint64(32) | docs.rank[owner])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    code, part = (key >> np.uint64(32)).astype(np.int32), docs.part[at]
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
    first = at[starts]
    own = [docs.groups.take(pa.array(first))] if docs.groups is not None else []
    return [hex_codes(code[starts]), *own, pa.array(docs.block[first], mask=docs.null[first]), _shorts(starts, len(code), docs.low[at])]


def listed(rows: DataFrame, texts: list[str], key: str, group: str | None = None, binary: bool = False, limits: bool = True) -> DataFrame:
    """The postings of :func:`exploded` as lists ``tri, group, block, offs``, many ids a row; see :func:`id_of`.

    Of one trigram, group and block there are several lists.
    """
    keep = [*([group] if group else []), key]
    selected, names, _ = _select(rows, texts, keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["tri", *([group] if group else []), "block", "offs"]
        held: list[list] = [[], [], [], []]
        n = docs = 0
        for batch in batches:
            body = joined(batch.columns[len(keep) :])
            there = body.is_valid().to_numpy(zero_copy_only=False)
            for run in runs(body):
                row, code = distinct(run)
                good = there[run.first : run.first + run.rows]
                if limits:
                    good = good & fits(run, row, binary)
                use = good[row]
                held[0].append(code[use])
                held[1].append(row[use] + (run.first + docs))
                n += len(held[0][-1])
            held[2].append(batch.column(len(keep) - 1))
            held[3].append(batch.column(0))
            docs += batch.num_rows
            if n >= LIST_POSTINGS:
                yield pa.RecordBatch.from_arrays(_lists(np.concatenate(held[0]), np.concatenate(held[1]), _ranked(held[2], held[3] if group else [])), columns)
                held, n, docs = [[], [], [], []], 0, 0
        if n:
            yield pa.RecordBatch.from_arrays(_lists(np.concatenate(held[0]), np.concatenate(held[1]), _ranked(held[2], held[3] if group else [])), columns)

    return selected.mapInArrow(apply, _list_schema(group, dict(rows.dtypes)[group] if group else "int"))


def gathered(postings: DataFrame, key: str) -> DataFrame:
    """``postings(tri, key)`` as lists ``tri, block, offs``; the longer they are, the better the rows are sorted."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(1).cast(pa.int64()).to_numpy()
            ends = np.asarray(pc.run_end_encode(batch.column(0)).run_ends)
            new = np.zeros(len(number), bool)
            new[np.append(0, ends[:-1])] = True
            block, low = number >> BLOCK_BITS, ((number & _LOW) - _MID).astype(np.int16)
            new[1:] |= (block[1:] != block[:-1]) | (low[1:] < low[:-1])
            starts = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(block[starts]), _shorts(starts, len(number), low)], ["tri", "block", "offs"])

    there = small_batches(postings.where(F.col(key).isNotNull()).select("tri", key))
    return there.mapInArrow(apply, _list_schema(None, "int"))


def blocks(lists: DataFrame, ordered: bool = False) -> DataFrame:
    """One list for each trigram, group and block, its ids in order; ``ordered``: in ranges of those, and sorted by them."""
    own = [c for c in lists.columns if c != "offs"]
    spread = lists.repartitionByRange(*own) if ordered else lists
    one = spread.groupBy(*own).agg(F.collect_list("offs").alias("__parts"))
    offs = F.when(F.size("__parts") == 1, F.col("__parts")[0]).otherwise(F.sort_array(F.flatten("__parts")))
    one = one.select(*own, offs.alias("offs"))
    return one.sortWithinPartitions(*own) if ordered else one


def id_of(block: Column, off: Column) -> Column:
    return F.shiftleft(block, BLOCK_BITS) + off.cast("long") + F.lit(_MID)


def postings_of(lists: DataFrame, key: str) -> DataFrame:
    """Rows ``tri, group, key`` of some lists, in their order."""
    own = [c for c in lists.columns if c not in ("offs", "block")]
    return lists.select(*own, "block", F.explode("offs").alias("__off")).select(*own, id_of(F.col("block"), F.col("__off")).alias(key))


# --- positions as lists


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes ``start, start + 1, ...`` of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences within lists; the first of each as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _sums(gaps: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values whose :func:`_gaps` these are."""
    total = np.cumsum(gaps)
    return total - np.repeat(total[starts] - gaps[starts], counts)


def _binaries(numbers: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Variable-length numbers as one binary for each of the rows that begin at these places."""
    data, sizes = codecs.varints(numbers)
    ends = np.append(np.concatenate([[0], np.cumsum(sizes)])[rows], len(data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _numbers(binaries: pa.Array) -> np.ndarray:
    """All numbers of such binaries."""
    full = pc.fill_null(binaries, b"").cast(pa.large_binary())
    at = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
    return codecs.read_varints(np.frombuffer(full.buffers()[2], np.uint8)[at[0] : at[-1]]) if at[-1] > at[0] else np.zeros(0, np.int64)


PLACED = types.StructType(
    [types.StructField("tri", types.StringType()), types.StructField("block", types.LongType()), types.StructField("files", types.IntegerType()), types.StructField("n", types.LongType())]
    + [types.StructField(c, types.BinaryType()) for c in ("offs", "counts", "places", "drifts")]
)


def placed(rows: DataFrame, texts: list[str], key: str) -> DataFrame:
    """The positions of :func:`every_position` as lists ``tri, block, files, n, offs, counts, places, drifts``, many a row; :func:`places` reads them.

    A list has ``n`` positions in ``files`` documents, whose ids are
    ``block * 65536 + offs``.  Of each there are so many positions as
    ``counts`` says, with their byte offsets in ``places`` and by how much
    these are greater than the character offsets in ``drifts`` (null: all
    alike).  All are variable-length numbers; offs, places and drifts are gaps.
    """
    selected, _, _ = _select(rows, texts, [key])

    def flush(held: list[list[np.ndarray]], ids: list[pa.Array]) -> pa.RecordBatch:
        code, owner, counts, place, drift = (np.concatenate(x) for x in held)
        docs = _ranked(ids, [])
        by = code.astype(np.uint64) << np.uint64(32) | docs.rank[owner]
        order = np.argsort(by, kind="stable")
        take = _ragged((np.cumsum(counts) - counts)[order], counts[order])
        place, drift, counts, code, at = place[take], drift[take], counts[order], code[order], (by[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.cumsum(counts) - counts
        part = docs.part[at]
        lists = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
        spot = first[lists]  # the first position of each list
        moved = np.maximum.reduceat(drift, spot) > 0
        used = np.repeat(moved, np.diff(np.append(spot, len(drift))))
        drifts = _gaps(drift, first)[used]
        sizes = np.diff(np.append(spot, len(drift)))[moved]
        some = _binaries(drifts, np.cumsum(sizes) - sizes)
        where = np.where(moved, np.cumsum(moved) - 1, 0)
        columns = [hex_codes(code[lists]), pa.array(docs.block[at[lists]], mask=docs.null[at[lists]])]
        columns += [pa.array(np.diff(np.append(lists, len(code))).astype(np.int32)), pa.array(np.diff(np.append(spot, len(place))))]
        columns += [_binaries(_gaps(docs.low[at].astype(np.int64) + _MID, lists), lists)]
        return pa.RecordBatch.from_arrays([*columns, _binaries(counts, lists), _binaries(_gaps(place, first), spot), some.take(pa.array(where, mask=~moved))], PLACED.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        ids: list[pa.Array] = []
        n = docs = 0
        for batch in batches:
            ids.append(batch.column(0))
            for run in runs(joined(batch.columns[1:])):
                for row, code, place, rune in _positions(run):
                    by = row.astype(np.uint64) << np.uint64(56) | code.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
                    by.sort()
                    shifts = np.zeros(len(place), np.int32)
                    if len(place) and (shifted := place - rune).any():
                        # a piece's places follow each other within a row, so a row's first one tells where the others are
                        fresh = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        base = np.zeros(run.rows, np.int64)
                        base[row[fresh]] = fresh - place[fresh]
                        shifts = shifted[base[(by >> np.uint64(56)).astype(np.int64)] + (by & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                    own = by >> np.uint64(32)
                    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                    own = own[starts]
                    for to, what in zip(held, ((own & np.uint64(0xFFFFFF)).astype(np.int32), (own >> np.uint64(24)).astype(np.int64) + (run.first + docs), np.diff(np.append(starts, len(by))), (by & np.uint64(0xFFFFFFFF)).astype(np.int32), shifts)):
                        to.append(what)
                    n += len(by)
                    if n >= LIST_POSITIONS:
                        yield flush(held, ids)
                        held, ids, n, docs = [[], [], [], [], []], [batch.column(0)], 0, 0
            docs += batch.num_rows
        if n:
            yield flush(held, ids)

    return selected.mapInArrow(apply, PLACED)


def places(lists: DataFrame, key: str) -> DataFrame:
    """``tri, key, places, drifts`` of lists of :func:`placed`: the positions of a trigram in a document, ascending."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tri, block, files, _, offs, counted, placed_at, drifted = batch.columns
            each = files.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(each)), each)
            low = _sums(_numbers(offs), np.cumsum(each) - each, each)
            ids = (np.asarray(pc.fill_null(block, 0))[row] << BLOCK_BITS) + low
            counts = _numbers(counted)
            starts = np.cumsum(counts) - counts
            place = _sums(_numbers(placed_at), starts, counts)
            drift = np.zeros(len(place), np.int64)
            drift[np.repeat(np.asarray(drifted.is_valid())[row], counts)] = _numbers(drifted)
            drift = _sums(drift, starts, counts)
            moved = np.maximum.reduceat(drift, starts) > 0
            ends = pa.array(np.append(0, np.cumsum(np.where(moved, counts, 0))).astype(np.int32))
            far = pa.ListArray.from_arrays(ends, pa.array(drift[np.repeat(moved, counts)].astype(np.int32)), mask=pa.array(~moved))
            near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([tri.take(pa.array(row)), pa.array(ids, mask=np.asarray(block.is_null())[row]), near, far], ["tri", "key", "places", "drifts"])

    return small_batches(lists.select(*PLACED.names)).mapInArrow(apply, "tri string, key long, places array<int>, drifts array<int>").withColumnRenamed("key", key)
