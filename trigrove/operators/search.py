"""Ranked, verified search over a trigram index.

Candidates are the documents with any trigram of the query, ranked by BM25 or
by the number of trigrams; the best ``2 * max_results`` of them are verified
against their stored text.  Only the query's trigrams, their document counts
and the final rows reach the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import trigrams as T
from .index import TrigramIndex

#: Values up to which a lookup is a filter that Parquet prunes by; longer ones join.
IN_LIST = 200
#: Values of one IN list; Parquet takes longer ones for the range from their least to their greatest.
IN_GROUP = 10
SNIPPETS = "array<struct<line_number:int,byte_offset:long,line_content:string,matches:array<struct<start:int,end:int>>>>"


@dataclass(frozen=True)
class SearchOptions:
    ranking: str = "bm25"  # or "trigram_count"
    k1: float = 1.2
    b: float = 0.75
    context_lines: int = 2
    max_snippets_per_file: int = 10
    #: Candidates that are verified, as a multiple of the results; None: all.
    candidate_factor: int | None = 2


def idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def any_of(column: str, values: list) -> Column:
    """Whether a column has one of the values, as short IN lists that each prune row groups and pages."""
    groups = [F.col(column).isin(values[i : i + IN_GROUP]) for i in range(0, len(values), IN_GROUP)]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(False)


def documents_of(candidates: DataFrame, docs: DataFrame, most: int | None) -> DataFrame:
    """The candidates with their documents; of at most ``most`` (None: any number of) candidates.

    A few candidates' ids go to the driver, so that only the row groups that hold them are read.
    """
    if most is None or most > IN_LIST:
        return candidates.join(docs, "file_id")
    rows = candidates.collect()
    few = docs.sparkSession.createDataFrame(rows, candidates.schema)
    return docs.where(any_of("file_id", sorted(r["file_id"] for r in rows))).join(F.broadcast(few), "file_id").select(*few.columns, *(c for c in docs.columns if c != "file_id"))


def hits(postings: DataFrame, tris: list[str]) -> DataFrame:
    """The postings of some trigrams."""
    if len(tris) <= IN_LIST:
        return postings.where(any_of("tri", sorted(tris)))
    wanted = postings.sparkSession.createDataFrame([(t,) for t in tris], "tri string")
    return postings.join(F.broadcast(wanted), "tri", "left_semi")  # at most MAX_TRIGRAMS rows


def hits_of(index: TrigramIndex, tris: list[str]) -> DataFrame:
    """The same of an index: of one that isn't stored, only these trigrams are looked for in its texts."""
    found = index.hits(tris)
    return hits(index.postings, tris) if found is None else found


def trigram_count_rank(index: TrigramIndex, tris: list[str]) -> DataFrame:
    """``file_id, matched, score, rank_key`` of each candidate, by the number of its query trigrams."""
    found = hits_of(index, tris).groupBy("file_id").agg(F.count("*").alias("matched"))
    return found.select("file_id", "matched", F.col("matched").cast("double").alias("score"), F.col("matched").alias("rank_key"))


def bm25_rank(index: TrigramIndex, tris: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same by BM25 with a term frequency of 1.

    A document's length is the number of its query trigrams, the mean length
    the number of query trigrams that the index holds at all.
    """
    n = index.file_count
    found = hits_of(index, tris)
    frequency = {r["tri"]: r["n"] for r in found.groupBy("tri").agg(F.count("*").alias("n")).collect()}  # a row for each query trigram
    weights = index.postings.sparkSession.createDataFrame([(t, idf(n, df)) for t, df in frequency.items()], "tri string, idf double")
    summed = found.join(F.broadcast(weights), "tri").groupBy("file_id").agg(F.count("*").alias("matched"), F.sum("idf").alias("s"))
    norm = F.lit(k1 + 1.0) / (F.lit(1.0) + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("matched") / F.lit(float(max(1, len(frequency))))))
    scored = summed.select("file_id", "matched", (F.col("s") * norm).alias("score"))
    # the sum's last bits depend on its order; they are rounded off before truncation
    return scored.withColumn("rank_key", F.floor(F.round(F.greatest(F.col("score"), F.lit(0.0)) * 1000, 6)))


def best(ranked: DataFrame, limit: int | None) -> DataFrame:
    ordered = ranked.orderBy(F.desc("rank_key"), F.asc("file_id"))
    return ordered if limit is None else ordered.limit(limit)


# --- snippets


def line_starts(data: bytes) -> list[int]:
    """A line starts at 0 and after each line feed that isn't the last byte."""
    return [0, *(m.end() for m in re.finditer(b"\n", data) if m.end() < len(data))]


def find_line(starts: list[int], offset: int) -> int:
    """Index of the line that an offset is in: the last one that starts at or before it."""
    return max(0, bisect_right(starts, offset) - 1)


def _lines_around(data: bytes, spans: list[tuple[int, int]], context: int, most: int) -> list[dict]:
    starts = line_starts(data)
    by_line: dict[int, list[dict]] = {}
    for lo, hi in spans:
        at = find_line(starts, lo)
        by_line.setdefault(at, []).append({"start": lo - starts[at], "end": hi - starts[at]})
    shown = sorted({k for line in by_line for k in range(max(0, line - context), min(len(starts) - 1, line + context) + 1)})
    out = []
    for k in shown[:most]:
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(data)
        out.append({"line_number": k + 1, "byte_offset": starts[k], "line_content": data[starts[k] : end].decode("utf-8", "replace"), "matches": by_line.get(k, [])})
    return out


def literal_spans(data: bytes, query: bytes) -> list[tuple[int, int]]:
    """Every occurrence, overlapping ones too."""
    out, at = [], data.find(query)
    while at >= 0:
        out.append((at, at + len(query)))
        at = data.find(query, at + 1)
    return out


#: Pairs of noncharacters that mark matches; the first pair that a text doesn't hold is used.
MARKS = [("\ufdd0", "\ufdd1"), ("\ufdd2", "\ufdd3"), ("\ufdd4", "\ufdd5"), ("\ufdd6", "\ufdd7")]


def marked(text: Column, pattern: str) -> Column:
    """The text with a mark before and after each match, preceded by the two marks.

    The JVM's engine finds the matches, as it does for the filter.  Null where a
    text holds characters of all pairs.
    """
    cases = None
    for a, b in MARKS:
        free = (F.instr(text, a) == 0) & (F.instr(text, b) == 0)
        made = F.concat(F.lit(a + b), F.regexp_replace(text, F.lit(pattern), F.lit(f"{a}$0{b}")))
        cases = F.when(free, made) if cases is None else cases.when(free, made)
    return cases


def marked_spans(body: str) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of a marked text without its marks, and the byte spans of the matches."""
    a, b, text = body[0], body[1], body[2:]
    out: list[tuple[int, int]] = []
    pieces: list[bytes] = []
    at = 0
    for part in text.split(a):
        inside, _, after = part.partition(b) if pieces else ("", "", part)
        raw = inside.encode()
        if pieces:
            out.append((at, at + len(raw)))
        pieces += [raw, rest := after.encode()]
        at += len(raw) + len(rest)
    return b"".join(pieces), out


def _name_snippet(name: bytes, query: bytes) -> list[dict]:
    at = name.find(query)
    return [{"line_number": 0, "byte_offset": 0, "line_content": name.decode(), "matches": [{"start": at, "end": at + len(query)}]}]


def _with_snippets(rows: DataFrame, make: Callable[[str, object], list[dict] | None]) -> DataFrame:
    """``snippets`` and ``match_count`` instead of ``name_text`` and ``content``; rows without a match go."""
    kept = [c for c in rows.columns if c != "content"]
    types = dict(rows.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_number", pa.int32()), ("byte_offset", pa.int64()), ("line_content", pa.string()), ("matches", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
        for batch in batches:
            names, contents = batch.column(batch.schema.get_field_index("name")).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            made = [make(n or "", c) for n, c in zip(names, contents)]
            keep = pa.array([m is not None for m in made])
            found = [m for m in made if m is not None]
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:-1]), pa.array([len(m) for m in found], pa.int32()), pa.array(found, kind)], [*kept, "match_count", "snippets"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["match_count int", f"snippets {SNIPPETS}"])
    return rows.select(*kept, "content").mapInArrow(apply, schema)


def _bytes(content: object) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content or b"")  # type: ignore[arg-type,call-overload]


# --- searches


@dataclass
class Searcher:
    index: TrigramIndex
    options: SearchOptions = SearchOptions()

    def ranked(self, tris: list[str]) -> DataFrame:
        o = self.options
        return bm25_rank(self.index, tris, o.k1, o.b) if o.ranking == "bm25" else trigram_count_rank(self.index, tris)

    def candidates(self, tris: list[str], max_results: int | None, count: bool = False) -> DataFrame:
        """The candidates that get verified."""
        ranked = trigram_count_rank(self.index, tris) if count else self.ranked(tris)
        most = self._most(max_results)
        return ranked if most is None else best(ranked, most)

    def _most(self, max_results: int | None) -> int | None:
        factor = self.options.candidate_factor
        return None if max_results is None or factor is None else factor * max_results

    def empty(self) -> DataFrame:
        id_type = dict(self.index.docs.dtypes)["file_id"]
        return self.index.docs.sparkSession.createDataFrame([], f"file_id {id_type}, matched long, score double, rank_key long, name string, match_count int, snippets {SNIPPETS}")

    def search(self, query: str, max_results: int | None = 100) -> DataFrame:
        """Documents whose name or content holds ``query``, byte for byte, best first; with ``max_results=None`` every one, in no order."""
        tris = T.of_query(query)
        if not tris or max_results is not None and max_results <= 0:
            return self.empty()
        o, raw = self.options, query.encode()
        found = documents_of(self.candidates(tris, max_results), self.index.docs, self._most(max_results))
        needle = F.lit(query) if dict(self.index.docs.dtypes)["content"] == "string" else F.lit(raw)
        found = found.where(F.contains("name", F.lit(query)) | F.contains("content", needle))

        def make(name: str, content: object) -> list[dict] | None:
            if raw in name.encode():
                return _name_snippet(name.encode(), raw)
            data = _bytes(content)
            spans = literal_spans(data, raw)
            return _lines_around(data, spans, o.context_lines, o.max_snippets_per_file) if spans else None

        made = _with_snippets(found, make)
        return made if max_results is None else best(made, max_results)

    def search_regex(self, pattern: str, max_results: int | None = 100) -> DataFrame:
        """Documents whose content matches ``pattern`` (of Java); no row if the pattern isn't valid. ``max_results`` as in :meth:`search`."""
        docs = self.index.docs
        if not valid_pattern(docs, pattern) or max_results is not None and max_results <= 0:
            return self.empty()
        tris = patterns.required_trigrams(pattern)
        text = F.col("content").cast("string")
        o = self.options
        if tris:
            found = documents_of(self.candidates(tris, max_results, count=True), docs, self._most(max_results)).where(text.rlike(pattern))
        else:
            found = docs.where(text.rlike(pattern))
            found = found if max_results is None else found.orderBy("file_id").limit(max_results)
            found = found.select("file_id", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank_key"), "name", "content")
        found = found.withColumn("content", F.coalesce(marked(text, pattern), text))

        def make(name: str, content: object) -> list[dict] | None:
            body = str(content or "")
            if body[:2] in MARK_PAIRS:
                data, spans = marked_spans(body)
            else:  # a text with characters of all pairs of marks: its lines are shown, without places
                data, spans = body.encode(), [(0, 0)]
            return _lines_around(data, spans, o.context_lines, o.max_snippets_per_file) if spans else None

        made = _with_snippets(found, make)
        return made if max_results is None else best(made, max_results)


MARK_PAIRS = {a + b for a, b in MARKS}


def valid_pattern(docs: DataFrame, pattern: str) -> bool:
    """Whether the JVM's regular expressions accept it."""
    from pyspark.errors import IllegalArgumentException

    try:
        docs.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True
