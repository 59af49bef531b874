"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Writing: each task writes one archive per partition, a gzip member per record,
into the shared folder, under a name of its own attempt; only the names that
finished attempts report are read, so a lost or repeated task leaves no trace.

Reading: each file is cut into byte ranges.  A task looks for the gzip magic in
its range, inflates the head of each candidate and accepts it if it opens with
a WARC version line; from there it walks from member to member.  It owns the
records that start inside its range and reads past the end to finish the last.

Edge cases: a null payload is empty.  Payloads under ``MIN_REVISIT`` bytes are
always responses.  Of rows with equal payloads and equal smallest ids, all are
responses.  A row without an id is never the response that others revisit while
a row with an id has the same payload; alone it is a response.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path

#: Payloads of fewer bytes are never deduplicated.
MIN_REVISIT = 100
#: Bytes of an archive that one task reads.
SPLIT_BYTES = 32 << 20
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = (f"{name}: {' '.join(value.split())}" for name, value in fields)
    return ("WARC/1.1\r\n" + "\r\n".join(clean) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", url or "")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _member(body: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(body) + squeeze.flush()


def with_revisits(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """``__payload``, ``__digest`` and ``__refers_to`` (null: a response) beside the key."""
    base = pages.withColumn("__payload", F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    base = base.withColumn("__digest", F.sha2("__payload", 256))
    # a row for each payload that occurs again, without the payload; partial counts absorb hot payloads
    again = base.where(F.octet_length("__payload") >= MIN_REVISIT).groupBy("__digest").agg(F.min(key).alias("__first"), F.count("*").alias("n")).where("n > 1 and __first is not null").select("__digest", "__first")
    joined = base.join(again, "__digest", "left")
    return joined.withColumn("__refers_to", F.when(~F.col(key).eqNullSafe(F.col("__first")), F.col("__first")))


def write(pages: DataFrame, folder: str | None = None, payload: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Archive every row; ``path, bytes, records`` of each archive that was finished."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        size = records = 0
        with out.open_output_stream(path, compression=None) as sink:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    body = _member(record(*row))
                    sink.write(body)
                    size += len(body)
                    records += 1
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

    rows = with_revisits(pages, payload, key).select(F.col(key).cast("long"), url, "__payload", "__digest", F.col("__refers_to").cast("long"))
    done = rows.mapInArrow(save, "path string, bytes long, records long").collect()  # a row for each task
    return spark.createDataFrame([(f"{folder.rstrip('/')}/{r['path'].rpartition('/')[2]}", r["bytes"], r["records"]) for r in done if r["records"]], "path string, bytes long, records long")


class _Window:
    """A file read forwards in blocks."""

    def __init__(self, source: BinaryIO, at: int):
        self.source, self.at, self.held = source, at, bytearray()  # at: file position of held[0]; grows in place
        source.seek(at)

    def more(self) -> bool:
        block = self.source.read(_BLOCK)
        self.held += block
        return bool(block)

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _inflated(window: _Window) -> bytes | None:
    """The member at the window's start, whose bytes are taken from the window; None if there is none."""
    inflate = zlib.decompressobj(31)
    out: list[bytes] = []
    used = 0
    feed = bytes(window.held)
    checked = False
    while True:
        try:
            out.append(inflate.decompress(feed))
        except zlib.error:
            return None
        if not checked and sum(map(len, out[:4])) >= 5:
            if not b"".join(out[:4]).startswith(b"WARC/"):
                return None
            checked = True
        if inflate.eof:
            used = len(window.held) - len(inflate.unused_data)
            body = b"".join(out)
            if not body.startswith(b"WARC/"):
                return None
            window.skip(used)
            return body
        before = len(window.held)
        if not window.more():
            return None
        feed = bytes(window.held[before:])


def _parsed(body: bytes) -> dict[str, object]:
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    own = fields.get("WARC-Page-ID")
    refers = fields.get("WARC-Refers-To-Page-ID")
    kind = fields["WARC-Type"]
    return {
        "page_id": None if own is None else int(own),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": None if refers is None else int(refers),
        "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].partition(":")[2],
    }


def records_in(source: BinaryIO, begin: int, end: int) -> Iterator[dict[str, object]]:
    """The records whose gzip members start in ``[begin, end)``."""
    window = _Window(source, begin)
    synced = begin == 0
    while window.at < end:
        if not window.held and not window.more():
            return
        if not synced:
            found = window.held.find(_MAGIC)
            if found < 0:
                window.skip(max(0, len(window.held) - 2))  # the magic may straddle blocks
                if not window.more():
                    return
                continue
            window.skip(found)
            if window.at >= end:
                return
        body = _inflated(window)
        if body is not None:
            synced = True
            yield _parsed(body)
        elif synced:
            raise ValueError(f"no WARC record at byte {window.at}")
        else:
            window.skip(1)


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def read(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Every record of ``archives(path, bytes)``; without ``payload`` only its length and digest leave the task."""
    ranges = archives.select("path", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0), {int(split_bytes)}L)")).alias("begin"), "bytes")
    ranges = ranges.withColumn("end", F.least(F.col("begin") + split_bytes, "bytes")).select("path", "begin", "end")
    # about one range a partition, dealt out in turn
    n = max(1, min(10_000, ranges.count()))
    names = [f.split()[0] for f in _FIELDS.split(", ") if payload or not f.startswith("payload binary")]
    schema = ", ".join(f for f in _FIELDS.split(", ") if payload or not f.startswith("payload binary"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                source, at = fs.FileSystem.from_uri(path)
                with source.open_input_file(at) as file:
                    held: list[dict[str, object]] = []
                    size = 0
                    for row in records_in(file, begin, end):
                        size += int(row["payload_bytes"]) if payload and row["payload"] is not None else 200  # type: ignore[call-overload]
                        held.append(row)
                        if size > 8 << 20:
                            yield _batch(held, names, schema)
                            held, size = [], 0
                    yield _batch(held, names, schema)

    return ranges.repartition(n).mapInArrow(scan, schema)


def _batch(rows: list[dict[str, object]], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = dict(f.split() for f in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[types[n]]) for n in names], names)
