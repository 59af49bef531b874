"""Quality rules: base statistics of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed word unigrams and bigrams are estimated: one from
every row of the corpus, one from every trusted row.  A document's score is the
mean, over its n-grams, of ``log p_trusted - log p_corpus``; the length
normalisation makes one threshold fit all lengths.  The threshold is a number
that the caller fixes or that :func:`fit` derives from the scores of all
labelled rows, so each document's verdict is a function of its own text and of
the two tables alone.

Edge cases: a null or empty text has no words, all statistics 0 and fails the
base rules.  A text without an n-gram scores 0.  Without trusted rows the ratio
is 0 everywhere and the base rules decide alone.  Repeated rows count as often
as they occur.  Other columns are passed through unless they bear the name of
a result column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import written

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Share of the trusted rows that the threshold may reject, at most.
LOSS = 0.002
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean")]


def _later(key: np.ndarray) -> np.ndarray:
    """Of each key, whether an equal one comes before it."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def _repeated_windows(data: np.ndarray, w: X.Words, at: np.ndarray) -> np.ndarray:
    """Of the three-word windows that start at words ``at``, those that their text holds twice or more.

    Windows are sorted by a hash of row and words; neighbours that share one are
    compared byte for byte, and numbered exactly should the bytes differ.
    """
    h = w.hash
    key = X.mix(h[at] * np.uint64(3) + X.mix(h[at + 1] + np.uint64(7)) * np.uint64(5) + X.mix(h[at + 2] ^ np.uint64(0x5851F42D4C957F2D))) ^ X.mix(w.row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    one, two = at[order[:-1]], at[order[1:]]
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    one, two = one[same], two[same]
    equal = w.row[one] == w.row[two]
    for d in range(3):
        equal &= X.same_bytes(data, w.start[one + d], w.end[one + d], None, w.start[two + d], w.end[two + d])
    if not equal.all():
        word, _ = X.exact_ids(data, w.start, w.end, h)
        order = np.lexsort((word[at + 2], word[at + 1], word[at], w.row[at]))
        one, two = at[order[:-1]], at[order[1:]]
        equal = (w.row[one] == w.row[two]) & np.all([word[one + d] == word[two + d] for d in range(3)], 0)
        one, two = one[equal], two[equal]
    return np.concatenate([one, two])


def statistics(part: X.Texts, w: X.Words) -> dict[str, np.ndarray]:
    n, data, offsets = len(part.offsets) - 1, part.data, part.offsets
    lead = X.counted_prefix((data & 0xC0) != 0x80)
    symbols = X.counted_prefix(_SYMBOL[data])
    n_words = np.diff(w.bounds)
    word_chars = X.per_row(lead[w.end] - lead[w.start], w.row, n).astype(np.int64)
    start, end, row = X.lines(part)
    first = np.searchsorted(w.start, start)
    full = (first < len(w.start)) & (np.append(w.start, len(data))[first] < end) if len(start) else np.zeros(0, bool)
    start, end, row = start[full], end[full], row[full]
    line, lines = X.exact_ids(data, start, end)
    dup = _later(row * max(1, lines) + line)
    covered = np.zeros(len(w.start), bool)
    if len(w.start) >= 3:
        at = _repeated_windows(data, w, np.flatnonzero(w.row[:-2] == w.row[2:]))
        covered[at] = covered[at + 1] = covered[at + 2] = True
    repeat = np.bincount(w.row[covered], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(row[dup], minlength=n),
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words),
    }


def features(w: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams, and the row of each."""
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    one = w.hash >> shift
    if len(w.row) < 2:
        return one.astype(np.int64), w.row
    at = np.flatnonzero(w.row[:-1] == w.row[1:])
    two = X.mix(w.hash[at] * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + 1]) >> shift
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([w.row, w.row[at]])


class Model(NamedTuple):
    ratio: np.ndarray  # log p_trusted - log p_corpus of each bucket
    threshold: float


def scores(w: X.Words, n: int, ratio: np.ndarray) -> np.ndarray:
    bucket, row = features(w)
    total = np.bincount(row, minlength=n)
    return np.bincount(row, weights=ratio[bucket], minlength=n)[:n] / np.maximum(total, 1)


def count_buckets(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``bucket, n_corpus, n_trusted`` over every row; ``trusted`` holds distinct keys in a column ``k``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            for part in X.texts(batch.column(1)):
                bucket, row = features(X.words(part))
                corpus += np.bincount(bucket, minlength=BUCKETS)
                mine = known[part.first : part.first + len(part.offsets) - 1][row]
                target += np.bincount(bucket[mine], minlength=BUCKETS)
        at = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(corpus[at]), pa.array(target[at])], ["bucket", "n_corpus", "n_trusted"])

    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    # the keys grow with the corpus: one plan for all sizes, which shuffles the texts once and broadcasts nothing
    known = trusted.select("k", F.lit(True).alias("known")).hint("merge")
    marked = texts.join(known, "k", "left").select(F.col("known").isNotNull(), "t")
    parts = marked.mapInArrow(count, "bucket int, n_corpus long, n_trusted long")
    return parts.groupBy("bucket").agg(F.sum("n_corpus").alias("n_corpus"), F.sum("n_trusted").alias("n_trusted"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """The bucket table: at most ``BUCKETS`` rows reach the driver."""
    table = count_buckets(docs, trusted, text, key).toPandas()
    corpus, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    corpus[table.bucket], target[table.bucket] = table.n_corpus, table.n_trusted
    if not target.sum():
        return np.zeros(BUCKETS)
    prior = (corpus + 1) / (corpus.sum() + BUCKETS)
    # the trusted multinomial is shrunk towards the corpus, with the weight of one n-gram a bucket
    return np.log((target + BUCKETS * prior) / (target.sum() + BUCKETS)) - np.log(prior)


def _between(low: float, below: float | None) -> float:
    return float(np.nextafter(low, -np.inf)) if below is None else float((low + below) / 2)


def fit_threshold(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The score under which a text is rejected, from scores in memory.

    Half way between the score that at most ``loss`` of the good ones are
    below and the nearest bad score beneath it, so that texts like the good ones
    stay clear of it; minus infinity without a good one.
    """
    if not len(good):
        return float("-inf")
    low = np.sort(good)[int(loss * len(good))]
    below = bad[bad < low]
    return _between(low, below.max() if len(below) else None)


def _ordered(number: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles whose bits they are, or those bits again."""
    return np.where(number < 0, number ^ np.int64((1 << 63) - 1), number)


def _score(ordered: int) -> float:
    return float(_ordered(np.array([ordered], np.int64)).view(np.float64)[0])


def _nth(values: DataFrame, n: int) -> int:
    """The value of column ``o`` that ``n`` others come before: 16 bits a round, of which at most 65,536 counts reach the driver."""
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("o", shift)
        for found, count in sorted(tuple(r) for r in values.groupBy(digit).count().collect()):
            if n < count:
                break
            n -= count
        values = values.where(digit == found)
    return found


def threshold_of(scored: DataFrame, loss: float = LOSS) -> float:
    """:func:`fit_threshold` of a table of any size: ``q`` is 1 for good rows and 0 for bad ones, ``o`` the ordered score."""
    good = scored.where("q = 1")
    n = good.count()
    if not n:
        return float("-inf")
    low = _nth(good, int(loss * n))
    below = scored.where((F.col("q") == 0) & (F.col("o") < low)).agg(F.max("o")).first()[0]
    return _between(_score(low), None if below is None else _score(below))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The ratio over all ``docs``, and a threshold from all rows of ``labels(key, quality)``."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).select(F.col(key).cast("long").alias("k"), F.col("quality").cast("int").alias("q")).distinct()
    ratio = fit_ratio(docs, known.where("q = 1").select("k"), text, key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            long = [np.zeros(0, bool)]
            for part in X.texts(batch.column(1)):
                w = X.words(part)
                out.append(scores(w, len(part.offsets) - 1, ratio))
                long.append(~statistics(part, w)["base_failed"])
            ordered = _ordered((np.concatenate(out) + 0.0).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ordered), pa.array(np.concatenate(long))], ["k", "o", "ok"])

    # every text is scored where it lies, so that only keys and scores meet the labels
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null")
    scored = texts.mapInArrow(score, "k long, o long, ok boolean").where("ok").join(known, "k").select("q", "o")
    return Model(ratio, threshold_of(written(scored, "quality-scores")))


def quality_rules(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's statistics, ``llr``, and ``kept``: the base rules hold and the ratio reaches the threshold."""
    ratio, threshold = model
    names = [n for n, _ in STATISTICS] + ["llr", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in names]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]
    at = carried.index(text) if text in carried else len(carried)  # a text that is carried travels once
    extra = [] if text in carried else [F.col(text).alias("__text")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, np.ndarray]] = []
            for part in X.texts(batch.column(at)):
                w = X.words(part)
                found = statistics(part, w)
                found["llr"] = scores(w, len(part.offsets) - 1, ratio)
                found["kept"] = ~found["base_failed"] & (found["llr"] >= threshold)
                out.append(found)
            if out:
                values = [pa.array(np.concatenate([o[n] for o in out])) for n in names]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(safe)], *values], [*safe, *names])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + [f"{n} {t}" for n, t in STATISTICS] + ["llr double", "kept boolean"])
    return docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), *extra).mapInArrow(apply, schema).toDF(*carried, *names)
