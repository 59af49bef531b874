import random

from tests.compare import assert_same
from tests.llm import edges
from trigrove.llm import linededup as D
from trigrove.llm.queries import ORACLES


def brute(docs, least):
    """``docs``: (id, text) by id.  A line goes if it is in a run of enough words that occurred before."""
    flat, where = [], {}
    for i, t in docs:
        full = [x for x in t.split("\n") if x.split()]
        where[i] = len(flat)
        flat += [(x, len(x.encode().split())) for x in full] + [(None, 0)]
    gone = set()
    for s in range(len(flat)):
        best = 0
        for e in range(s):
            n = 0
            while s + n < len(flat) and flat[s + n][0] is not None and flat[s + n][0] == flat[e + n][0]:
                n += 1
            best = max(best, n)
        if sum(w for _, w in flat[s : s + best]) >= least:
            gone.update(range(s, s + best))
    out = {}
    for i, t in docs:
        at, kept, cut = where[i], [], False
        n = removed = 0
        for x in t.split("\n"):
            if x.split():
                cut = at in gone
                at += 1
                n += 1
                removed += cut
            if not cut:
                kept.append(x)
        out[i] = ("\n".join(kept), n, removed) if removed else (t, n, 0)
    return out


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in D.line_dedup(docs, min_words=least).collect()}
    assert got == brute(sorted(rows), least)


def test_runs_match_brute_force(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice(["a", "b b", "c c c", "", "d", "e e"]) for _ in range(r.randint(0, 14)))) for i in range(25)]
    rows.append((25, rows[3][1]))
    check(spark, rows, 4)


def test_long_runs_and_overlaps(spark):
    base = "\n".join(f"line number {i} of the passage" for i in range(40))
    rows = [(0, base), (1, "start\n" + base + "\nend"), (2, "\n".join(base.split("\n")[5:30])), (3, "x y z\n" * 9), (4, base)]
    check(spark, rows, 6)


def test_edges(spark):
    docs = edges.frame(spark)
    got = D.line_dedup(docs).collect()
    assert len(got) == docs.count() and D.line_dedup(docs).columns.count("n") == 1
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[2][0]["text"] == ""
    assert by[0][0]["n_removed"] == 0 and [r["text"] for r in by[4]] == ["", ""]  # the rows of id 4 copy id 0
    assert [r["n_removed"] for r in by[None] if r["text"]] == [0, 0]  # equal rows are one document
    assert by[9][0]["n_removed"] == by[8][0]["n_lines"] - 1  # all but the line with the tail
    assert D.line_dedup(edges.empty(spark)).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert_same(D.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text"), d, ORACLES["op1_line_dedup"])
