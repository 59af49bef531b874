import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trigrove.llm import _text as X

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab Cé\n\t\x0b\x0c\r\x1c", max_size=20)), max_size=8)


@given(TEXT, st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_words_and_lines(texts, limit):
    rows = 0
    for part in X.texts(pa.array(texts, pa.string()), limit):
        n = len(part.offsets) - 1
        own = [(t or "").encode() for t in texts[part.first : part.first + n]]
        assert part.first == rows and [part.data[a:b].tobytes() for a, b in zip(part.offsets, part.offsets[1:])] == own
        rows += n
        w = X.words(part)
        raw = part.data.tobytes()
        assert [[raw[w.start[k] : w.end[k]] for k in range(w.bounds[i], w.bounds[i + 1])] for i in range(n)] == [t.split() for t in own]
        start, end, row = X.lines(part)
        assert [[raw[a:b] for a, b, r in zip(start, end, row) if r == i] for i in range(n)] == [t.split(b"\n") if t else [] for t in own]
    assert rows == len(texts)


def test_slices_of_columns():
    column = pa.array(["zero", None, "two", "three"]).slice(1, 3)
    assert [p.data.tobytes() for p in X.texts(column)] == [b"twothree"]
    assert list(X.texts(pa.array([], pa.string()))) == []
    assert [p.data.tobytes() for p in X.texts(pa.chunked_array([["a"], ["b"]]))] == [b"ab"]


def test_hashes_depend_on_the_bytes_alone(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choices("abcABC", k=r.randint(1, 9))) for _ in range(3000)]
    part = next(iter(X.texts(pa.array([" ".join(words)]))))
    w = X.words(part)
    seen = {}
    for word, h in zip(words, w.hash.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    low = X.words(part, lower=True).hash
    assert [low[i] for i in range(len(words)) if words[i].islower()] == [w.hash[i] for i in range(len(words)) if words[i].islower()]
    monkeypatch.setattr(X, "CHUNK_BYTES", 50)
    assert (X.words(part).hash == w.hash).all()
    assert X.segment_hash(part.data, np.zeros(0, np.int64), np.zeros(0, np.int64)).size == 0
