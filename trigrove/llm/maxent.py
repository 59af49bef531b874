"""A hashed maximum-entropy language model with a class-factored softmax, and the add-one unigram score.

The words of the vocabulary, and one leaf for every form that all other words
have (closing punctuation, last letters, letters beyond ASCII), are the leaves
of a tree of classes: a node has at most :data:`BRANCH` children, of about equal
mass, so frequent words have short paths.  ``P(word | history)`` is the product
of the softmaxes along its path; of a form, a word has its add-one unigram
share.  A softmax adds up hashed feature rows, chosen by node and history: the
previous word, the last very frequent word before (a skip) and, in the root, the
previous two words.  It starts from the corpus's unigrams.  Vocabulary words
stand in the tree in the order of the frequent words that they occur after, so
classes hold words of one language or subject.

The vocabulary, the feature rows and the buckets of other words in a history
grow as the root of the number of training tokens (:func:`sizes`), a word's
work as the vocabulary's logarithm.

Training makes :data:`ROUNDS` (one) rounds of distributed gradient updates, each over
all training rows: each task walks its rows with AdaGrad from the round's
weights and sends the rows of the table that it changed; their means, weighted
by use, are the next weights.  A round takes so few tasks that the tables they
send stay a bounded part of the input.  The word counts stay a table: the
:data:`TOP` words, or the vocabulary if it is larger, go to the tasks, the
others are joined.

Words are held as 64-bit hashes.  Edge cases: a null or empty text is one end
token.  Rows without an id are held out.  With no training row every count is
0 and the model is uniform over the forms.  Repeated rows count and are
scored as often as they occur; an empty table gives an empty result.  Of the
columns that are carried, those that bear the name of a result column are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import written

#: Children of a node of the tree of classes, at most.
BRANCH = 16
#: Least and most words of the vocabulary, and words for each root of a training token.
VOCAB, MOST_VOCAB, VOCAB_GROWTH = 512, 1 << 20, 8
#: Leaves of the other words, by form.
FORMS = 256
#: Least hash buckets for other words in a history.
OTHERS = 512
#: Least and most feature rows, and rows for each root of a training token; the most bound a worker's memory (64 bytes a row).
ROWS, MOST_ROWS, ROWS_GROWTH = 1 << 14, 1 << 22, 32
#: Most frequent words that the last skip feature looks back for.
ANCHORS = 256
#: Very frequent words that describe where others occur, and how often the vocabulary is halved by those descriptions.
MARKERS, HALVINGS = 32, 5
#: Levels of the tree that see all features of a history, and how many of them the lower levels see.
UPPER, LOWER_FEATURES = 1, 2
#: Words whose counts every task holds.
TOP = 300_000
ROUNDS = 1
#: Tokens of a gradient step.
BATCH = 1 << 12
RATE = 0.3
_BLOCK = 256  # rows of the table that travel together
#: Tasks whose changes one task adds up.
FAN_IN = 64
#: Training tokens of a task for each row of the table that it sends.
TOKENS_A_ROW = 48
#: Tasks of a round on a small input.
LEAST_TASKS = 6
END = np.uint64(0x656E64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(True))


_CLOSING = np.zeros(256, np.int64)
_CLOSING[33:48] = _CLOSING[58:65] = _CLOSING[91:97] = _CLOSING[123:127] = 3
_CLOSING[list(b".!?")], _CLOSING[list(b",;:")] = 1, 2


def forms(data: np.ndarray, w: X.Words) -> np.ndarray:
    """The class of each word's form: closing punctuation x (its last two letters, or its letters beyond ASCII)."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    closing = _CLOSING[data[w.end - 1]]
    last = np.maximum(w.end - 1 - (closing > 0), w.start)
    before = np.maximum(last - 1, w.start)
    pair = (data[last] & 0xDF).astype(np.uint64) * np.uint64(257) + (data[before] & 0xDF)
    beyond = np.maximum.reduceat(np.where((data & 0xC0) == 0x80, data, 0), w.start).astype(np.int64)
    ending = (X.mix(pair) % np.uint64(32)).astype(np.int64)
    return closing * 64 + np.where(beyond > 0, 32 + (ending + beyond) % 32, ending)


def tokens(part: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and forms of the lower-cased words with an end after each row, and ``rows + 1`` bounds."""
    w = X.words(part, lower=True)
    return np.insert(w.hash, w.bounds[1:], END), np.insert(forms(part.data, w), w.bounds[1:], 0), w.bounds + np.arange(len(w.bounds))


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, forms and counts with each word once."""
    key, form, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, form, n = key[order], form[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], form[first], np.add.reduceat(n, first) if len(first) else n


_NO_WORDS = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    key, form, n = words
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(form.astype(np.int32)), pa.array(n)], ["w", "form", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``w, form, n`` over every row given; a task sums its own rows before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = _NO_WORDS, [], 0
        for batch in batches:
            for part in X.texts(batch.column(0)):
                key, form, _ = tokens(part)
                parts.append(_merged([(key, form, np.ones(len(key), np.int64))]))
                size += len(parts[-1][0])
                if size > 1 << 20:
                    held, parts, size = _merged([held, *parts]), [], 0
                if len(held[0]) > 2 << 20:  # a task's memory is bounded: the shuffle adds up what it sends early
                    yield _counted(held)
                    held = _NO_WORDS
        yield _counted(_merged([held, *parts]))

    return docs.select(text).mapInArrow(count, "w long, form int, n long").groupBy("w").agg(F.max("form").alias("form"), F.sum("n").alias("n"))


def sizes(total: int) -> tuple[int, int]:
    """Words of the vocabulary and feature rows for so many training tokens."""
    root = total**0.5
    return min(MOST_VOCAB, max(VOCAB, int(VOCAB_GROWTH * root))), min(MOST_ROWS, max(ROWS, -(-int(ROWS_GROWTH * root) // _BLOCK) * _BLOCK))


class Tree(NamedTuple):
    """Node and child on each level (rows) of the path to each leaf (columns), and the length of the paths."""

    node: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    bias: np.ndarray  # log share of each node's children


def tree(mass: np.ndarray) -> Tree:
    """Leaves in the given order, cut again and again into at most :data:`BRANCH` runs of about equal mass."""
    leaves = len(mass)
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(mass, 1e-3))])
    node, child = [np.full(leaves, -1, np.int32)], [np.zeros(leaves, np.uint8)]
    bias: list[np.ndarray] = []
    level = [(0, leaves)]
    while level:
        after = []
        for a, b in level:
            if b - a <= BRANCH:
                cuts = np.arange(a, b + 1)
            else:
                inner = np.searchsorted(sums, sums[a] + (sums[b] - sums[a]) * np.arange(1, BRANCH) / BRANCH)
                cuts = np.unique(np.concatenate([[a], np.clip(inner, a, b), [b]]))
                if len(cuts) == 2:  # nearly all mass is the last leaf's
                    cuts = np.array([a, b - 1, b])
            row = np.full(BRANCH, -1e4)
            for k, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                row[k] = np.log((sums[hi] - sums[lo]) / (sums[b] - sums[a]))
                child[-1][lo:hi] = k
                if hi - lo > 1:
                    after.append((lo, hi))
            node[-1][a:b] = len(bias)
            bias.append(row)
        level = after
        if level:
            node.append(np.full(leaves, -1, np.int32))
            child.append(np.zeros(leaves, np.uint8))
    nodes = np.stack(node)
    return Tree(nodes, np.stack(child), (nodes >= 0).sum(0).astype(np.uint8), np.stack(bias).astype(np.float32))


def starts_of(top: np.ndarray) -> np.ndarray:
    """An index of sorted hashes by their first bits, two to four slots for each: a look-up needs no binary search."""
    bits = max(1, (2 * len(top)).bit_length())
    slot = (top >> np.uint64(64 - bits)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=1 << bits))]).astype(np.int32)


def _first_bits(starts: np.ndarray) -> np.uint64:
    """How far a hash is shifted for its slot."""
    return np.uint64(64 - (len(starts) - 1).bit_length() + 1)


class Model(NamedTuple):
    top: np.ndarray  # sorted hashes of the most frequent words
    top_n: np.ndarray
    rank: np.ndarray  # of each of them in the vocabulary, or -1
    total: int
    distinct: int
    other_size: np.ndarray  # of each form's words beyond the vocabulary: tokens, words and one unknown
    leaf: np.ndarray  # of each vocabulary word, by rank; the forms' leaves follow
    tree: Tree
    rows: np.ndarray  # feature rows x children
    starts: np.ndarray  # of each value of a hash's first bits: the place of the first top word with it (starts_of)

    @property
    def others(self) -> int:
        """Buckets of other words in a history."""
        return max(OTHERS, len(self.rows) // 32)

    def leaves(self, rank: np.ndarray, form: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return form
        return np.where(rank >= 0, self.leaf[rank], len(self.leaf) + form)

    def ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the top words (or -1), and vocabulary rank (or -1)."""
        if not len(self.top):
            none = np.full(len(key), -1)
            return none, none
        slot = (key >> _first_bits(self.starts)).astype(np.int64)
        place, end = self.starts[slot].astype(np.int64), self.starts[slot + 1]
        at = np.full(len(key), -1)
        left = np.flatnonzero(place < end)
        while len(left):  # half of the slots or more are empty, so few tokens need a second look
            p = place[left]
            hit = self.top[p] == key[left]
            at[left[hit]] = p[hit]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] < end[left]]
        return at, np.where(at >= 0, self.rank[at], -1)


def _least_count(counts: DataFrame, top: int) -> int:
    """The smallest count, of eight steps an octave, that at most ``top`` words reach: no sort is needed."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = sorted(((r["s"], r["k"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()), reverse=True)
    held, least = 0, 1 << 62
    for _, k, n in sizes:
        held += k
        if held > top:
            break
        least = n
    return least


def unigram_model(counts: DataFrame) -> Model:
    """The model before training: at most :data:`TOP` words, or the vocabulary's, reach the driver."""
    by_form = {r["form"]: (r["t"], r["v"]) for r in counts.groupBy("form").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()}
    total, distinct = sum(t for t, _ in by_form.values()), sum(v for _, v in by_form.values())
    size, rows = sizes(total)
    table = counts.where(F.col("n") >= _least_count(counts, max(TOP, size))).toArrow()
    key, n, form = table["w"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["form"].to_numpy()
    order = np.lexsort((key, -n))
    key, n, form = key[order], n[order], form[order]
    vocab = min(size, len(key))
    rank = np.where(np.arange(len(key)) < vocab, np.arange(len(key)), -1)
    other = np.ones(FORMS)
    for f, (t, v) in by_form.items():
        other[f] += t + v
    np.subtract.at(other, form[:vocab], n[:vocab] + 1)
    order = np.argsort(key)
    return Model(key[order], n[order], rank[order], total, distinct, other, np.arange(vocab), tree(np.append(n[:vocab], other)), np.zeros((rows, BRANCH), np.float32), starts_of(key[order]))


def _last(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each token, the place of the last marked one before it in its text, or -1."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else np.zeros(0, np.int64)
    before = np.concatenate([[-1], at[:-1]]) if len(at) else at
    return np.where(before >= np.repeat(bounds[:-1], np.diff(bounds)), before, -1)


def history(key: np.ndarray, rank: np.ndarray, bounds: np.ndarray, others: int = OTHERS) -> np.ndarray:
    """Hashes of the features of each token's history: one word back, the last very frequent one (a skip), two words back."""
    own = np.where(rank >= 0, rank, (1 << 40) + (key % np.uint64(others)).astype(np.int64)) + 1  # 0: before the text
    first = bounds[:-1][np.diff(bounds) > 0]
    back = np.zeros((2, len(own)), np.int64)
    back[0, 1:], back[1, 2:] = own[:-1], own[:-2]
    back[0, first] = 0
    back[1, first] = 0
    second = first + 1
    back[1, second[second < len(own)]] = 0
    a, b = back.astype(np.uint64)
    last = _last((rank >= 0) & (rank < ANCHORS), bounds)
    c = np.where(last >= 0, own[last], 0).astype(np.uint64)
    return np.stack([X.mix(a * np.uint64(3) + np.uint64(1)), X.mix(c * np.uint64(5) + np.uint64(4)), X.mix(a * _GOLD + b * np.uint64(3))])


def neighbourhoods(docs: DataFrame, m: Model, text: str = "text") -> np.ndarray:
    """Vocabulary words x markers: how often a word occurs after each of the most frequent words, none of them between.

    Over all rows given; at most MOST_VOCAB * MARKERS numbers reach the driver.
    """
    vocab = len(m.leaf)
    shared = docs.sparkSession.sparkContext.broadcast(m._replace(rows=np.zeros((0, BRANCH), np.float32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(vocab * MARKERS, np.int32)
        for batch in batches:
            for part in X.texts(batch.column(0)):
                key, _, bounds = tokens(part)
                _, rank = shared.value.ids(key)
                last = _last((rank >= 0) & (rank < MARKERS), bounds)
                known = (last >= 0) & (rank >= 0)
                np.add.at(held, rank[known] * MARKERS + rank[last[known]], np.int32(1))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at].astype(np.int64))], ["cell", "n"])

    found = docs.select(text).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocab * MARKERS, np.float32)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(vocab, MARKERS)


def word_order(near: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Vocabulary ranks so ordered that words of like neighbourhoods stand together; by frequency inside a group.

    Neighbourhoods become square roots of smoothed shares; the words are cut in
    half, by occurrences, along the direction in which they differ most, and the
    halves again.
    """
    usual = near.sum(0) + 1
    usual /= usual.sum()
    x = np.sqrt((near + 2 * usual) / (near.sum(1, keepdims=True) + 2))
    done: list[np.ndarray] = []
    waiting = [(np.arange(len(near)), HALVINGS)]
    while waiting:
        own, left = waiting.pop()
        if not left or len(own) < 2 * BRANCH:
            done.append(own)
            continue
        weight = np.sqrt(n[own]).astype(np.float32)
        y = x[own] - weight @ x[own] / weight.sum()
        way = np.linalg.eigh((y * weight[:, None]).T.astype(np.float64) @ y)[1][:, -1]
        way *= np.sign(way[np.abs(way).argmax()])
        by = np.argsort((y @ way).round(6), kind="stable")
        sums = np.cumsum(n[own][by])
        cut = min(max(int(np.searchsorted(sums, sums[-1] / 2, "right")), 1), len(by) - 1)
        waiting += [(np.sort(own[by[cut:]]), left - 1), (np.sort(own[by[:cut]]), left - 1)]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def grouped(m: Model, near: np.ndarray) -> Model:
    """The model with its vocabulary's leaves in :func:`word_order`."""
    vocab = len(m.leaf)
    if not vocab:
        return m
    n = np.empty(vocab, np.int64)
    n[m.rank[m.rank >= 0]] = m.top_n[m.rank >= 0]
    order = word_order(near, n)
    leaf = np.empty(vocab, np.int64)
    leaf[order] = np.arange(vocab)
    return m._replace(leaf=leaf, tree=tree(np.append(n[order], m.other_size)))


class Choices(NamedTuple):
    """The decisions on the paths of some tokens, level by level."""

    token: np.ndarray
    node: np.ndarray
    child: np.ndarray
    high: int  # decisions on the first UPPER levels
    above: np.ndarray  # their rows: features x decisions
    below: np.ndarray  # the rows of the others

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Every use of a row, and the decision that it belongs to."""
        rest = np.arange(self.high, len(self.token))
        return np.concatenate([self.above.ravel(), self.below.ravel()]), np.concatenate([np.tile(np.arange(self.high), len(self.above)), np.tile(rest, len(self.below))])


def choices(m: Model, feature: np.ndarray, leaf: np.ndarray) -> Choices:
    t = m.tree
    deep = t.depth[leaf]
    token = np.concatenate([np.flatnonzero(deep > level) for level in range(len(t.node))]) if len(leaf) else np.zeros(0, np.int64)
    node = np.concatenate([t.node[level][leaf[deep > level]] for level in range(len(t.node))])
    child = np.concatenate([t.child[level][leaf[deep > level]] for level in range(len(t.node))])
    high = int(np.minimum(deep, UPPER).sum())

    def rows(features: slice, part: slice) -> np.ndarray:
        mixed = X.mix(feature[features, token[part]] + (node[part].astype(np.uint64) + np.uint64(1)) * _GOLD)
        return (((mixed >> np.uint64(32)) * np.uint64(len(m.rows))) >> np.uint64(32)).astype(np.int64)

    return Choices(token, node, child, high, rows(slice(None), slice(high)), rows(slice(LOWER_FEATURES), slice(high, None)))


def _exponentials(m: Model, weights: np.ndarray, c: Choices) -> tuple[np.ndarray, np.ndarray]:
    """Of each decision the children's unnormalised shares, and their sum."""
    z = m.tree.bias.take(c.node, 0)
    for r in c.above:
        z[: c.high] += weights.take(r, 0)
    for r in c.below:
        z[c.high :] += weights.take(r, 0)
    np.minimum(z, 80, out=z)  # the biases are at most 0; this bound only keeps the sum finite
    np.exp(z, out=z)
    return z, np.einsum("ij->i", z)


def log_probabilities(m: Model, feature: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural logs of each leaf's probability."""
    out = np.empty(len(leaf))
    for at in range(0, len(leaf), BATCH):
        c = choices(m, feature[:, at : at + BATCH], leaf[at : at + BATCH])
        z, total = _exponentials(m, m.rows, c)
        own = np.log(np.maximum(z[np.arange(len(z)), c.child], 1e-37) / total)
        out[at : at + BATCH] = np.bincount(c.token, own, len(out[at : at + BATCH]))
    return out


_ROW = f"V{4 * BRANCH}"


class _Trainer:
    """The table's AdaGrad state in a task."""

    def __init__(self, m: Model):
        self.model, self.weights = m, m.rows.copy()
        self.whole = self.weights.view(_ROW).ravel()  # a row at a time is quicker to put back
        self.squares = np.full(len(m.rows), 1e-2, np.float32)
        self.used = np.zeros(len(m.rows), np.int64)

    def update(self, feature: np.ndarray, leaf: np.ndarray) -> None:
        c = choices(self.model, feature, leaf)
        slope, total = _exponentials(self.model, self.weights, c)
        slope /= total[:, None]
        slope[np.arange(len(slope)), c.child] -= 1
        flat, decision = c.rows()
        order = np.argsort((flat & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by counting
        order = order[np.argsort((flat >> 16).astype(np.uint16)[order], kind="stable")]
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        uses = np.diff(np.append(first, len(flat)))
        order = decision[order]
        change = slope.take(order[first], 0)  # most rows are used once in a batch
        many = np.flatnonzero(uses > 1)
        if len(many):
            ends = np.cumsum(uses[many])
            change[many] = np.add.reduceat(slope.take(order[np.repeat(uses > 1, uses)], 0), ends - uses[many], axis=0)
        own = flat[first]
        self.used[own] += uses
        squares = self.squares[own] + np.einsum("ij,ij->i", change, change) / BRANCH
        self.squares[own] = squares
        change *= (RATE / np.sqrt(squares))[:, None]
        weights = self.weights.take(own, 0)
        weights -= change
        np.put(self.whole, own, weights.view(_ROW).ravel())


def _fit_task(m: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _Trainer(m)
    for batch in batches:
        for part in X.texts(batch.column(0)):
            key, form, bounds = tokens(part)
            _, rank = m.ids(key)
            feature, leaf = history(key, rank, bounds, m.others), m.leaves(rank, form)
            for at in range(0, len(key), BATCH):
                table.update(feature[:, at : at + BATCH], leaf[at : at + BATCH])
    out: list[tuple[int, int, bytes, bytes]] = []
    own = TaskContext.get().partitionId()
    for b in range(len(m.rows) // _BLOCK):
        s = slice(b * _BLOCK, (b + 1) * _BLOCK)
        if table.used[s].any():
            out.append((b, own, table.used[s].astype("<f8").tobytes(), (table.weights[s] * table.used[s, None]).astype("<f4").tobytes()))
    yield _blocks(out)


_BLOCKS = "slot int, part int, used binary, total binary"


def _blocks(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    slot, part, used, total = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(part, pa.int32()), pa.array(used, pa.binary()), pa.array(total, pa.binary())], ["slot", "part", "used", "total"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slot and part while the rows stream by: memory follows the slots, not the tasks that sent them."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for slot, part, used, total in zip(*(c.to_pylist() for c in batch.columns)):
            u, t = np.frombuffer(used, "<f8"), np.frombuffer(total, "<f4").astype(np.float64)
            old = held.get((slot, part))
            held[slot, part] = (u, t) if old is None else (old[0] + u, old[1] + t)
    yield _blocks([(s, p, u.tobytes(), t.astype("<f4").tobytes()) for (s, p), (u, t) in held.items()])


def _summed(sent: DataFrame, parts: int, slots: int = ROWS // _BLOCK) -> DataFrame:
    """The blocks of ``parts`` tasks added up by slot, as a tree: no task reads more than :data:`FAN_IN` blocks of a slot."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        grouped = sent.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        sent = grouped.repartition(min(slots, 128) if parts == 1 else min(10_000, parts * 8), "slot", "part").mapInArrow(_add_blocks, _BLOCKS)
    return sent


def fit(docs: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """The model of the training rows ``docs``, whose word counts are given."""
    spark = docs.sparkSession
    model = unigram_model(counts)
    model = grouped(model, neighbourhoods(docs, model, text))
    rows = len(model.rows)
    tasks = max(LEAST_TASKS, model.total // (TOKENS_A_ROW * rows))
    own = docs.select(text).coalesce(tasks)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # the top words and the table
        sent = own.mapInArrow(lambda b, s=shared: _fit_task(s.value, b), _BLOCKS)
        table = model.rows.copy()
        for r in _summed(sent, tasks, rows // _BLOCK).collect():  # the rows of the table, each block once
            used = np.frombuffer(r["used"], "<f8")
            total = np.frombuffer(r["total"], "<f4").reshape(_BLOCK, -1)
            part = table[r["slot"] * _BLOCK : (r["slot"] + 1) * _BLOCK]
            part[used > 0] = total[used > 0] / used[used > 0, None]
        model = model._replace(rows=table)
        shared.destroy()
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str] | None = None, unigrams_only: bool = False) -> DataFrame:
    """``n_tokens, n_known, train_tokens, base_score, score`` of every row, with the columns ``keep``; with ``unigrams_only`` all but ``score``, for which the model needn't be trained."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in names]
    types = dict(docs.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ["__uid", "n_tokens", "__known", "__base", "__score", "__w", "__n"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        uid = TaskContext.get().partitionId() << 33
        base_low = np.log10(m.total + m.distinct + 1)
        other_low = np.log10(m.other_size)
        for batch in batches:
            for part in X.texts(batch.column(batch.num_columns - 1)):
                key, form, bounds = tokens(part)
                n = len(bounds) - 1
                row = np.repeat(np.arange(n), np.diff(bounds))
                at, rank = m.ids(key)
                share = np.where(at >= 0, np.log10(m.top_n[at] + 1.0), 0.0) if len(m.top) else np.zeros(len(key))
                if unigrams_only:
                    lm = np.zeros(len(key))
                else:
                    lm = log_probabilities(m, history(key, rank, bounds, m.others), m.leaves(rank, form)) / np.log(10)
                    lm += np.where(rank < 0, share - other_low[form], 0.0)
                tail = np.flatnonzero(at < 0)
                order = np.lexsort((key[tail], row[tail]))
                k, r = key[tail][order], row[tail][order]
                new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
                size = np.diff(np.append(new, len(k)))
                ends = pa.array(np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.first, n).columns[:-1],
                        pa.array(uid + np.arange(n)),
                        pa.array(np.diff(bounds)),
                        pa.array(np.bincount(row[at >= 0], minlength=n)),
                        pa.array(np.bincount(row, weights=share - base_low, minlength=n)),
                        pa.array(np.bincount(row, weights=lm, minlength=n)),
                        pa.ListArray.from_arrays(ends, pa.array(k[new].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(size.astype(np.int32))),
                    ],
                    [*safe, *extra],
                )
                uid += n

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["__uid long, n_tokens long, __known long, __base double, __score double, __w array<long>, __n array<int>"])
    # written, so that the row numbers that the join below returns to are the same ones
    rows = written(docs.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(text).alias("__text")).mapInArrow(apply, schema), "maxent-rows")
    pair = rows.select("__uid", F.explode(F.arrays_zip("__w", "__n")).alias("x")).select("__uid", F.col("x.__w").alias("w"), F.col("x.__n").alias("k"))
    # words beyond the top are rare by definition, so no key of this join is hot
    found = pair.join(counts.select("w", "n"), "w").groupBy("__uid").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("t"), F.sum("k").alias("u"))
    joined = rows.drop("__w", "__n").join(found, "__uid", "left")
    add = F.coalesce("t", F.lit(0.0))
    return joined.select(
        *(F.col(s).alias(c) for s, c in zip(safe, carried)),
        "n_tokens",
        (F.col("__known") + F.coalesce("u", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__base") + add).alias("base_score"),
        *([] if unigrams_only else [(F.col("__score") + add).alias("score")]),
    )


def lm_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", unigrams_only: bool = False) -> DataFrame:
    """Count, train and score: ``key, held_out`` and the scores of every row; with ``unigrams_only`` without training, and all but ``score``."""
    training = docs.where(~held_out(key)).select(key, text)
    counts = written(word_counts(training, text), "maxent-counts")
    model = unigram_model(counts) if unigrams_only else fit(training, counts, text)
    marked = docs.select(key, held_out(key).alias("held_out"), text)
    return score(marked, model, counts, text, [key, "held_out"], unigrams_only)
