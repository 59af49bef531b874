"""Language identification by cross-parsing entropy.

For each language a suffix automaton recognises every substring of a bounded
labelled training text.  A document is parsed greedily against each automaton:
a phrase is the longest substring that the automaton knows, together with the
next symbol if the training text lacks that symbol altogether.  ``phrases *
log2(training length) / symbols`` estimates the cross entropy in bits a symbol;
the language with the smallest estimate wins (ties: the smaller name).

Symbols are the UTF-8 bytes of the lower-case letters, and the space between
words: every script's letters stay apart, and an automaton never needs more
than 256 of them.

Texts are parsed whole.  Blocks of :data:`BLOCK` symbols step through the
automata at once in numpy, each as if a phrase began with it; then the phrase
that comes in from the block before is carried on until it ends where one of
the block's own phrases ends, from where on both parses are the same.  From a block
that this never happens in the parse goes on symbol by symbol.  So one very long
text is hardly slower than many short ones, and its phrases are those of a parse
from end to end.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.
Rows without a language, and held-out rows, teach nothing.  Without training
rows everything is ``und``.  With one language that language always wins, with
score 1.  Repeated rows are predicted alike, and equal texts teach once.  An
empty table gives an empty result.  Of the columns that are carried, those that
bear the name of a result column (``lang_pred``, ``score``, ``bits``) are
replaced by it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X

BLOCK = 512
#: The training text of a language: whole texts, at most so many; symbols of them together, and over all languages, about.
TRAIN_DOCS = 64
LANGUAGE_SYMBOLS = 32_000
TOTAL_SYMBOLS = 1_200_000
#: Bytes of a text that is taken before shorter and longer ones.
USUAL_BYTES = (300, 6_000)
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for everything else."""
    out = np.zeros(0x32400, np.uint32)
    for c in range(len(out)):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with one space (code 32) between words and before one that other characters precede; bounds of the rows; rows with a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = X.counted_prefix((data & 0xC0) != 0x80)[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    table = letters()
    low = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)
    filled = np.where(low == 0, 32, low)
    keep = low != 0
    keep[:-1] |= keep[1:]  # a non-letter stays as the space before a letter
    edge = at[1:][(at[1:] > 0) & (at[1:] < len(keep))] - 1
    keep[edge] = low[edge] != 0
    counts = np.diff(X.counted_prefix(keep)[at])
    return filled[keep], np.concatenate([[0], np.cumsum(counts)]), np.diff(X.counted_prefix(low != 0)[at]) > 0


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``text`` (symbols below ``width``); state 1 is the root, 0 none."""
    nxt: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.zeros((len(nxt), width), np.int32)
    for state, edges in enumerate(nxt):
        for c, to in edges.items():
            table[state, c] = to
    return table


def as_bytes(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, and the rows' bounds among them."""
    if not len(symbols) or symbols.max() < 128:
        return symbols.astype(np.uint8), bounds
    raw = np.frombuffer(symbols.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
    return raw, X.counted_prefix(1 + (symbols > 0x7F) + (symbols > 0x7FF) + (symbols > 0xFFFF).astype(np.int64))[bounds]


class Model(NamedTuple):
    names: list[str]
    code: np.ndarray  # symbol of each byte
    steps: np.ndarray  # of all automata, flat: state * width + symbol
    restart: np.ndarray  # language, symbol -> state after a phrase ended before the symbol
    roots: np.ndarray
    bits: np.ndarray  # log2 of each training text's length
    width: int


def _bounded(texts: list[str], most: int) -> np.ndarray:
    """Whole texts in order until they have ``most`` symbols; of a first one that is longer, passages from all over it."""
    got: list[np.ndarray] = []
    held = 0
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        letters_, bounds, _ = symbols_of(raw, np.array([0, len(raw)]))
        own = as_bytes(letters_, bounds)[0]
        if held + len(own) > most:
            if held:
                continue
            count = max(1, most // 1000)
            own = np.concatenate([own[at : at + most // count] for at in np.linspace(0, len(own) - most // count, count).astype(int)])
        got.append(own)
        held += len(own)
    return np.concatenate([*got, np.zeros(0, np.uint8)])


def train(samples: dict[str, list[str]]) -> Model:
    """Automata of the sample texts by language."""
    names = sorted(samples)
    most = max(2_000, min(LANGUAGE_SYMBOLS, TOTAL_SYMBOLS // max(1, len(names))))
    parts = {name: _bounded(samples[name], most) for name in names}
    names = [n for n in names if len(parts[n])]
    seen = np.bincount(np.concatenate([*(parts[n] for n in names), np.zeros(0, np.uint8)]), minlength=256)
    known = np.flatnonzero(seen)
    code = np.zeros(256, np.int64)  # 0: a byte that no training text holds
    code[known] = np.arange(1, 1 + len(known))
    width = len(known) + 1
    tables, roots, base = [], [], 0
    for n in names:
        t = automaton(code[parts[n]], width)
        tables.append(np.where(t > 0, t + base, 0).astype(np.int32))
        roots.append(base + 1)
        base += len(t)
    steps = np.concatenate([*tables, np.zeros((0, width), np.int32)]).ravel()
    roots_ = np.array(roots, np.int64)
    restart = np.array([steps[r * width : (r + 1) * width] for r in roots], np.int64).reshape(len(names), width)
    restart = np.where(restart == 0, roots_[:, None], restart)
    return Model(names, code.astype(np.uint8), steps, restart, roots_, np.log2([max(2, len(parts[n])) for n in names]), width)


def phrases(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases of each row against each language."""
    rows, langs = len(bounds) - 1, len(model.names)
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    if not blocks.sum() or not langs:
        return np.zeros((rows, langs))
    owner = np.repeat(np.arange(rows), blocks)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = bounds[:-1][owner] + order * BLOCK
    size = np.minimum(bounds[1:][owner] - begin, BLOCK)
    by = np.argsort(-size, kind="stable")  # longest first: the blocks still running are a prefix
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    owner, begin, size, order = owner[by], begin[by], size[by], order[by]
    coded = model.code[symbols]
    running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    state = np.repeat(model.roots[:, None], len(owner), 1)
    count = np.zeros((langs, len(owner)), np.int32)
    ends = np.zeros((langs, len(coded)), bool)  # a block's own phrases end before these symbols
    steps, width = model.steps, model.width
    for t in range(int(size[0])):
        k = running[t]
        s = coded[begin[:k] + t].astype(np.int64)
        to = steps[state[:, :k] * width + s]
        miss = to == 0
        count[:, :k] += miss
        ends[:, begin[:k] + t] = miss
        state[:, :k] = np.where(miss, model.restart[:, s], to)
    found = count.copy()
    lang, block = np.divmod(np.flatnonzero(np.repeat((order > 0)[None], langs, 0)), len(owner))
    before = np.zeros(len(owner), np.int64)
    before[place[1:]] = place[:-1]
    after = np.zeros(len(owner), np.int64)  # the same text's next block; 0: none, since the first place has no block before it in reach
    after[before[order > 0]] = np.flatnonzero(order > 0)
    follows = np.zeros(len(owner), bool)
    follows[before[order > 0]] = True
    own, mine, theirs = state[lang, before[block]], np.zeros(len(lang), np.int32), np.zeros(len(lang), np.int32)
    late: list[tuple[np.ndarray, ...]] = []  # blocks whose parse never met the one that came in
    l, b = lang, block
    for t in range(BLOCK):
        over = size[b] <= t
        if over.any():
            late.append((l[over], b[over], own[over], mine[over]))
            l, b, own, mine, theirs = l[~over], b[~over], own[~over], mine[~over], theirs[~over]
        if not len(l):
            break
        at = begin[b] + t
        s = coded[at].astype(np.int64)
        to = steps[own * width + s]
        miss = to == 0
        theirs = theirs + ends[l, at]
        mine = mine + miss
        met = miss & (ends[l, at] | (t == 0))
        found[l[met], b[met]] = mine[met] + count[l[met], b[met]] - theirs[met]
        go = ~met
        l, b, own, mine, theirs = l[go], b[go], np.where(miss, model.restart[l, s], to)[go], mine[go], theirs[go]
    late.append((l, b, own, mine))
    l, b, own, mine = (np.concatenate(x) for x in zip(*late))
    _carry_on(model, coded, begin, size, ends, count, state, found, np.where(follows, after, -1), owner, order, l, b, own, mine)
    return np.stack([np.bincount(owner, weights=found[i], minlength=rows) for i in range(langs)], 1) + (sizes > 0)[:, None]


def _carry_on(model: Model, coded: np.ndarray, begin: np.ndarray, size: np.ndarray, ends: np.ndarray, count: np.ndarray, alone: np.ndarray, found: np.ndarray, after: np.ndarray, owner: np.ndarray, order: np.ndarray, lang: np.ndarray, block: np.ndarray, own: np.ndarray, mine: np.ndarray) -> None:
    """Symbol by symbol from the blocks that were left in another state, to where the parse meets a block's own.

    Few blocks need it: those of texts that repeat themselves in step with nothing the automaton knows.
    """
    table, width = memoryview(model.steps), model.width
    last = (-1, -1, -1)
    for k in np.lexsort((order[block], owner[block], lang)).tolist():
        l, b = int(lang[k]), int(block[k])
        text = (l, int(owner[b]))
        if text == last[:2] and order[b] <= last[2]:
            continue  # the parse of an earlier block went on through this one
        found[l, b] = mine[k]
        state, restart = int(own[k]), model.restart[l].tolist()
        if state == alone[l, b]:
            continue
        while after[b] >= 0:
            b = int(after[b])
            part = slice(int(begin[b]), int(begin[b] + size[b]))
            misses = theirs = 0
            met = False
            for t, (s, end) in enumerate(zip(coded[part].tolist(), ends[l, part].tolist())):
                to = table[state * width + s]
                theirs += end
                if to:
                    state = to
                    continue
                misses += 1
                if end or not t:
                    met = True
                    break
                state = restart[s]
            found[l, b] = misses + count[l, b] - theirs if met else misses
            if met or state == alone[l, b]:
                break
        last = (*text, int(order[b]))


def predict(model: Model, part: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: unknown), score and bits a symbol of each row."""
    letters_, bounds, known = symbols_of(part.data, part.offsets)
    symbols, bounds = as_bytes(letters_, bounds)
    if not model.names:
        nothing = np.zeros(len(known))
        return np.full(len(known), -1), nothing, nothing
    cost = phrases(model, symbols, bounds) * model.bits / np.maximum(np.diff(bounds), 1)[:, None]
    best = np.argmin(cost, 1)
    ordered = np.sort(cost, 1)
    low = ordered[:, 0]
    score = 1 - low / np.maximum(ordered[:, 1], 1e-12) if cost.shape[1] > 1 else np.ones(len(low))
    return np.where(known, best, -1), np.where(known, np.clip(score, 0, 1), 0.0), np.where(known, low, 0.0)


def held_out(key: str):
    """Rows that teach nothing: crc32 of the key as text is divisible by 5, or there is no key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from at most :data:`TRAIN_DOCS` different texts of each language, chosen by their hashes, those of usual length first."""
    labelled = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    odd = ~F.octet_length(text).between(*USUAL_BYTES)
    rows = labelled.select(F.col(lang).alias("l"), F.col(key).alias("k"), odd.alias("odd"), F.xxhash64(text).alias("h"))
    # ranks up to a limit: each task sends the rows of at most TRAIN_DOCS texts of a language on, and copies of a text are one
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("l").orderBy("odd", "h"))).where(F.col("r") <= TRAIN_DOCS)
    chosen = {(r["l"], r["k"]): r["r"] for r in few.groupBy("l", "r").agg(F.min("k").alias("k")).collect()}
    if not chosen:
        return train({})
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k, n) for (n, k) in chosen], f"k {dict(docs.dtypes)[key]}, l string"))
    found = labelled.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(wanted, ["k", "l"])
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in found.groupBy("k", "l").agg(F.min("t").alias("t")).collect():  # one text of a repeated key
        samples.setdefault(r["l"], []).append((chosen[r["l"], r["k"]], r["t"]))
    return train({n: [t for _, t in sorted(v)] for n, v in samples.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` and ``bits`` (cross entropy a symbol) of every row, with the columns ``keep``."""
    names = ["lang_pred", "score", "bits"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in names]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]
    at = carried.index(text) if text in carried else len(carried)  # a text that is carried travels once
    extra = [] if text in carried else [F.col(text).alias("__text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TOTAL_SYMBOLS

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        labels = np.array([*m.names, UNKNOWN], object)
        for batch in batches:
            got = [predict(m, part) for part in X.texts(batch.column(at), max(X.CHUNK_BYTES // 2, 8 * X.CHUNK_BYTES // max(4, len(m.names))))]
            if got:
                pred, score, bits = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(safe)], pa.array(labels[pred], pa.string()), pa.array(score), pa.array(bits)], [*safe, *names])

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["lang_pred string", "score double", "bits double"])
    return docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), *extra).mapInArrow(apply, schema).toDF(*carried, *names)
