import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
import tiktoken

from tests.llm import edges
from trigrove.llm import _pretokens, bpe
from trigrove.llm import _text as X

PATH = str(P.path("byte_bpe_multi_50k.tiktoken"))
BITS = ["'s", "'t", "'re", "'ll", "'LL", "'", "''", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", "$", "ab", "  \n", " ", "　", "字", "😀", "re", "ve", "\x00", "\x1c", "́", " "]


def fuzz(n):
    r = random.Random(1)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_split_matches_the_pattern():
    pattern, texts = regex.compile(P.PATTERN), fuzz(5000)
    for part in X.texts(pa.array(texts), 4096):
        s = _pretokens.split(part)
        raw = part.data.tobytes()
        found = [raw[a:b].decode() for a, b in zip(s.start, s.end)]
        for i in range(len(part.offsets) - 1):
            assert found[s.bounds[i] : s.bounds[i + 1]] == pattern.findall(texts[part.first + i])


def test_ids_match_the_library():
    own, want = bpe.loaded(PATH), reference()
    texts = fuzz(3000) + ["a" * 20000, "ab" * 3000 + "x", "é" * 999, "!" * 4000, "<|endoftext|>", edges.LONG]
    for part in X.texts(pa.array(texts)):
        ids, bounds = own.encoder.rows(part)
        body, ends = own.decode(ids)
        assert body.tobytes() == part.data.tobytes()
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want.encode_ordinary(texts[part.first + i])


def test_cache_is_bounded():
    own = bpe.loaded(PATH)
    small = _pretokens.Encoder(lambda pieces: [own.piece(p) for p in pieces], cached=10)
    for t in ("one two three four five six seven", "eight nine ten eleven twelve", "one two") * 2:
        ids, _ = small.rows(next(iter(X.texts(pa.array([t])))))
        assert own.decode(ids)[0].tobytes() == t.encode()
        assert len(small.key) <= 10


def test_rank_queue_pops_in_order():
    q, r = bpe.RankQueue(50_256), random.Random(2)
    pairs = {(r.randrange(50_256), r.randrange(1000)) for _ in range(2000)} | {(0, 1), (50_255, 0)}
    for rank, position in pairs:
        q.push(rank, position)
    assert [q.pop() for _ in pairs] == sorted(pairs) and q.pop() == (-1, -1)


def test_edges(spark):
    docs, want = edges.frame(spark), reference()
    for r in bpe.digests(docs.select("doc_id", "text"), PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = want.encode_ordinary(r["text"] or "")
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.digests(docs, PATH).count() == docs.count() and bpe.digests(edges.empty(spark), PATH).count() == 0


def test_round_trip_frames(spark):
    docs = edges.frame(spark)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    for r in back.collect():
        assert r["decoded"] == (r["text"] or "")
