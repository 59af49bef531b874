"""Media columns: payloads stored as progressive JPEG coefficients, and RGB tensors read from them.

A payload's bytes, less 128, are the quantised coefficients (the format's unit)
of 4:2:0 blocks, 64 bytes a block; a comment holds the payload's length, and
blocks beyond it are zero.  Reading accumulates the scans, so the payload and
the image come from the stored file alone.

Edge cases: a null or empty text is a payload of 64 zero bytes.  Equal texts
give equal files and equal features; an empty table gives an empty result.  Of
the columns that are carried, those that bear the name of a result column are
replaced by it.  A payload may have up to
``4095**2 * 6`` blocks (6 GB), more than a Spark value holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import jpeg

#: Bytes of payload that step through the scans together.
CHUNK_BYTES = 3 << 20
_SAMPLING = ((2, 2), (1, 1), (1, 1))


def frame_of(blocks: int) -> jpeg.Frame:
    units = -(-blocks // 6)
    across = min(4095, int(np.ceil(np.sqrt(units))))
    return jpeg.Frame(16 * across, 16 * -(-units // across), (1, 2, 3), _SAMPLING, (0, 0, 0))


def stored(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose length is a positive multiple of 64."""
    frames = [frame_of(len(p) // 64) for p in payloads]
    values = []
    for p, f in zip(payloads, frames):
        own = np.zeros((f.blocks(), 64), np.int32)
        own.reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int32) - 128
        values.append(own)
    return jpeg.encode(frames, values, [len(p).to_bytes(8, "big") for p in payloads])


def read_back(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payloads and the RGB tensors of stored files."""
    images = [jpeg.parse(f) for f in files]
    blocks = jpeg.coefficients(images)
    payloads = [(b.reshape(-1)[: int.from_bytes(im.note, "big")] + 128).astype(np.uint8).tobytes() for im, b in zip(images, blocks)]
    pixels = jpeg.samples(np.concatenate(blocks), images[0].quant[0]) if images else np.zeros((0, 8, 8), np.uint8)
    ends = np.cumsum([len(b) for b in blocks])
    return payloads, [jpeg.rgb(im.frame, pixels[e - len(b) : e]) for im, b, e in zip(images, blocks, ends)]


def feature(image: np.ndarray) -> str:
    """Mean colour, and which of 4 x 4 cells are brighter than the image: hexadecimal."""
    height, width = image.shape[:2]
    cells = image.reshape(4, height // 4, 4, width // 4, 3).sum((1, 3), dtype=np.int64)
    total = cells.sum((0, 1))
    mean = total // (height * width)
    light = cells.sum(2)
    bits = (light * 16 > light.sum()).ravel()
    return bytes(mean.astype(np.uint8)).hex() + np.packbits(bits).tobytes().hex()


def _runs(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= CHUNK_BYTES):
            total += sizes[to]
            to += 1
        yield slice(at, to)
        at = to


def media_column(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_bytes`` and ``media``, the stored file of each text, with the columns ``keep``."""
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "media")]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.texts(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                raw, at = part.data.tobytes(), part.offsets.tolist()
                payloads = [(b := raw[x:y]) + bytes(-len(b) % 64 or (0 if b else 64)) for x, y in zip(at, at[1:])]
                own = batch.slice(part.first, len(payloads))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(np.diff(part.offsets)), pa.array(stored(payloads), pa.binary())], [*safe, "n_bytes", "media"])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["n_bytes long", "media binary"])
    return docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(text).alias("__text")).mapInArrow(apply, schema).toDF(*carried, "n_bytes", "media")


def rgb_tensors(files: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``height, width, rgb`` (row-major bytes) of each stored file; null files give nulls."""
    carried = [c for c in (files.columns if keep is None else keep) if c not in (media, "height", "width", "rgb")]
    types = dict(files.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            for run in _runs([len(f or b"") for f in found]):
                own = found[run]
                tensors = iter(jpeg.decode([f for f in own if f is not None]))
                rows = [None if f is None else next(tensors) for f in own]
                head = batch.slice(run.start, len(own)).columns[:-1]
                size = [[None if t is None else t.shape[i] for t in rows] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(size[0], pa.int32()), pa.array(size[1], pa.int32()), pa.array([None if t is None else t.tobytes() for t in rows], pa.binary())], [*safe, "height", "width", "rgb"])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["height int, width int, rgb binary"])
    return files.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(media).alias("__media")).mapInArrow(apply, schema).toDF(*carried, "height", "width", "rgb")


def digests(files: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Digests of the payload that each file gives back, of the file itself, and the image's feature."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    carried = [c for c in (files.columns if keep is None else keep) if c not in (media, *names)]
    types = dict(files.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1).to_pylist()
            for run in _runs([len(f) for f in found]):
                own = found[run]
                payloads, tensors = read_back(own)
                values = [
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(f) for f in own], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in own]),
                    pa.array([feature(t) for t in tensors]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(run.start, len(own)).columns[:-1], *values], [*safe, *names])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"])
    return files.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(media).alias("__media")).mapInArrow(apply, schema).toDF(*carried, *names)
