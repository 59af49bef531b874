"""Byte trigrams as column expressions: six hexadecimal digits for three UTF-8 bytes.

The hexadecimal form orders like the 24-bit number and needs no conversion in
Parquet filters; :func:`pack` and :func:`unpack` convert.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 1 << 30
MAX_LINE = 2000
MAX_TRIGRAMS = 20_000

#: A pair of adjacent bytes, in hexadecimal, that no text may hold.
_BAD_PAIR = "(?:[0-7].(?:[89AB].|F[89A-F])|[89AB].F[89A-F]|(?:[CDE].|F[0-7])(?:[0-7].|[C-F].)|F[89A-F]..)"


def trigrams(text: Column) -> Column:
    """Every trigram of a string or binary, in order, one for each start byte."""
    return F.regexp_extract_all(F.hex(text), F.lit("(?=(.{6}))(?:..)"), 1)


def distinct_trigrams(text: Column) -> Column:
    """The trigram set, in order of first occurrence; empty under three bytes."""
    return F.array_distinct(trigrams(text))


def pack(tri: Column) -> Column:
    """Six digits to the 24-bit number."""
    return F.conv(tri, 16, 10).cast("int")


def unpack(number: Column) -> Column:
    return F.lpad(F.hex(number), 6, "0")


def valid_pairs(data: Column) -> Column:
    """For BINARY: the adjacent bytes that close a trigram could stand in UTF-8."""
    return ~F.hex(data).rlike(f"^(?:..)+{_BAD_PAIR}")


def lines_fit(text: Column) -> Column:
    """No line is too long: 1999 bytes before a line feed, 2000 at the end of the text."""
    parts = F.split(text.cast("string"), "\n", -1)
    closed = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.forall(closed, lambda x: F.octet_length(x) < MAX_LINE) & (F.octet_length(F.element_at(parts, -1)) <= MAX_LINE)


def admitted(text: Column, tris: Column | None = None, binary: bool = False) -> Column:
    """Whether a text is indexed at all; a null text is not."""
    found = distinct_trigrams(text) if tris is None else tris
    if binary:
        plain = ~F.hex(text).rlike("^(?:..)*00") & valid_pairs(text)
    else:
        plain = F.instr(text, "\0") == 0  # strings are valid UTF-8
    ok = (F.octet_length(text) <= MAX_BYTES) & plain
    return F.coalesce(ok & lines_fit(text) & (F.size(found) <= MAX_TRIGRAMS), F.lit(False))


def of_query(query: str | bytes) -> list[str]:
    """The distinct trigrams of a query, on the driver; empty where no search can match."""
    raw = query.encode() if isinstance(query, str) else query
    if b"\0" in raw or len(raw) < 3:
        return []
    if max(map(len, raw.split(b"\n"))) > MAX_LINE:
        raise ValueError("a line of the query is too long")
    found = list(dict.fromkeys(raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)))
    if len(found) > MAX_TRIGRAMS:
        raise ValueError("the query has too many trigrams")
    return found


RUNE_STEP = 100


def rune_samples(text: Column) -> Column:
    """Byte offset of every 100th character.

    The text is cut into pieces of 100 characters once, and their byte lengths
    are added up, so the cost is linear.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUNE_STEP}}}"), 0)
    sizes = F.transform(pieces, lambda p: F.octet_length(p))
    start = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(sizes, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])


def rune_to_byte(text: Column, rune: Column) -> Column:
    """Byte offset at which a character (from 0) starts."""
    return F.octet_length(F.left(text, rune))
