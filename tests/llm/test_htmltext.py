import itertools
import random
import time

import numpy as np

from tests.llm import pages as by_hand
from trigrove.llm import gbt
from trigrove.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site. <button>OK</button></div><article><h1>A &amp; B</h1>
<p>First  paragraph\n with <b>bold</b> text &lt;here&gt; and a good number of words in it.<p>Second one, unclosed, also with a number of words.
<ul><li>Point one</li><li>Point two</li></ul><!-- <p>no</p> --></article>
<section class="comments"><h3>Comments</h3><p>I liked this article very much, thank you for writing it down.</p></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_article():
    assert H.main_texts([PAGE], H.model())[0] == "A & B\nFirst paragraph with bold text <here> and a good number of words in it.\nSecond one, unclosed, also with a number of words.\nPoint one\nPoint two"


def test_generated_pages():
    r, good = random.Random(1234), 0
    for _ in range(100):
        page = H.training_page(r)
        nodes = H.empty()
        H.parse(page, 0, nodes)
        truth = "\n".join(t.replace(H._MARK, "") for t in nodes.text if t and H._MARK in t)
        good += H.main_texts([page.replace(H._MARK, "")], H.model())[0] == truth
    assert good >= 75


def test_decoding_is_the_best_consistent_labelling():
    r = np.random.default_rng(3)
    for _ in range(40):
        n = int(r.integers(1, 9))
        parent = np.array([-1, *(int(r.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = r.normal(0, 2, n)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        value = lambda y: sum(yes[i] if y[i] else no[i] for i in range(n))  # noqa: B023, E731
        fits = [y for y in itertools.product([False, True], repeat=n) if all(not y[i] or i == 0 or y[parent[i]] for i in range(n))]
        got = H.decode(odds, parent, depth)
        assert tuple(got) in fits and np.isclose(value(got), max(map(value, fits)))


def test_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = gbt.fit(x, y, trees=30)
    assert ((t.log_odds(x) > 0) == (y > 0)).mean() > 0.97
    assert gbt.fit(x, np.ones(len(x)), trees=2).log_odds(x).min() > 0


def test_malformed_pages_do_not_fail_or_hang():
    r = random.Random(6)
    bits = ["<", ">", "</", "<p", "<div class='", '"', "'", "<!--", "-->", "<script>", "</script", "<a href=x>", "</a>", "&amp", "&#x;", "text", "<td>", "</div>", "<li>", "<br/>", "=", " ", "<p>", "<?x", "\x00"]
    pages = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]
    pages += ["<div>" * 20000, '<p "' * 20000, "<!--" * 20000, "<" * 50000, "</p>" * 20000, "<a b='c" * 20000, "x" * 500000, "", None]
    assert len(H.main_texts(pages, H.model())) == len(pages)


def test_extract(spark):
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (2, None, None, None, None), (None, "v", "", "y", 1), (3, "w", "plain words alone", "z", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, tag int")
    got = H.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and H.extract(pages).columns == ["page_id", "url", "tag", "text", "n_chars"]
    assert {r["text"] for r in got if r["page_id"] == 2} == {""}
    assert H.extract(pages.limit(0)).count() == 0


def test_pages_of_other_layouts():
    for html, text in by_hand.ALL:
        assert H.main_texts([html], H.model())[0] == text


def test_the_stored_trees_are_those_of_training():
    made, held = H.train(pages=60), H.model()
    assert made.feature.shape == held.feature.shape and made.leaf.shape == held.leaf.shape
    page = by_hand.BLOG[0]
    nodes = H.empty()
    H.parse(page, 0, nodes)
    assert (made.log_odds(H.features(nodes)) > 0).mean() > 0  # the same features


def test_time_follows_the_length():
    n = 100_000
    for bit in ("<a'", '<a ">"', "<a ", "<dt></dt>", "data-x", "<p class='data-", "<div><dd></dd>", '<a "b>'):
        for tail in ("", ">"):
            page = "<dt>" * (bit[1] == "d") + bit * n + tail
            began = time.time()
            nodes = H.empty()
            H.parse(page, 0, nodes)
            assert time.time() - began < 20, bit
            assert max(nodes.depth) <= H.DEEPEST + 1


def test_parsing_of_odd_tags():
    for html, want in [("a<b", "a<b"), ("1 < 2 &lt; 3", "1 < 2 < 3"), ("x<p title='>'>y</p>", "x|y"), ("x<p title='>y</p>z", "x|y|z"), ("<xmp>a &amp; b</xmp>", "a &amp; b"), ("a<!-- b", "a")]:
        nodes = H.empty()
        H.parse(html, 0, nodes)
        assert "|".join(t for t in nodes.text if t) == want, html
