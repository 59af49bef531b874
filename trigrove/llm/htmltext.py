"""Main-text extraction: boosted trees over DOM nodes, decoded so that the choices of a tree of nodes agree.

A page is parsed leniently into block elements and text blocks.  Every node has
features of its subtree (text, link and punctuation density), of its tag and
attribute tokens and its ancestors', of depth, position and siblings.  Boosted
trees give each node the odds that it holds main text.  The labelling with the
greatest likelihood is then chosen under the rule that a node without main text
has no descendant with any; a bottom-up and a top-down pass find it exactly.

There are no labelled pages, so the trees are trained on generated ones, whose
layouts, tags and attribute tokens vary (:func:`training_page`); the generator
and the seed are fixed, and so is the model.  :func:`train` made the trees that
lie beside this module, and makes the same ones again.

Edge cases: null, empty and text-free pages give the empty text.  Unclosed or
misnested tags, quotes and comments, at any length, are parsed like a browser
would roughly do, in time proportional to the page (but for sorting); scripts
and styles end with the page at the latest, and elements deeper than
:data:`DEEPEST` become siblings.  A ``<`` that no ``>`` follows is text.
Character references are decoded in each run of text by itself, so a tag inside
one leaves it as it is.  Repeated rows give equal texts; an empty table gives an
empty result.  Extra columns pass through, but ``text`` and ``n_chars`` are
replaced by the result's.
"""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/][^>]*+>?|[^<]++|<", re.S)
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label|itemprop|data-[\w-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_OPEN_END = re.compile("<[!?/]")
_UPPER = bytes(range(65, 91))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Bytes of pages whose nodes are held together, about.
PART_BYTES = 1 << 19
#: Elements on the path to a node, at most; browsers cut there too.
DEEPEST = 512
_RAW = {"script", "style", "textarea", "title", "iframe", "template", "select", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "object canvas audio video svg g text tspan textpath symbol use defs path circle ellipse rect line polyline polygon "
    "math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mfenced mstyle mpadded mphantom semantics annotation annotation-xml".split()
)
_GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div", "section", "article main", "nav", "header", "footer", "aside", "form fieldset button legend option", "table tbody thead tr td th", "figure figcaption", "blockquote pre", "body html head", "dialog details summary"]
_GROUP = {tag: i for i, tags in enumerate(_GROUPS) for tag in tags.split()}
_OTHER = len(_GROUPS)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"form", "body"}}
_KINDS = {
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promoted promotion dfp",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc topbar skip tabs sitemap",
    "head": "header masthead topnav logo brand branding hero",
    "foot": "footer copyright legal colophon bottom contentinfo credits",
    "side": "sidebar side aside rail widget widgets related recommended recommend recommendations popular trending similar complementary teaser",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe subscription signup paywall disclaimer warning",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread review reviews feedback",
    "form": "form search login signin register input contact poll survey",
    "share": "share sharing social follow facebook twitter like likes",
    "good": "article content post entry main body text story articlebody prose",
}
_KIND = {word: i for i, words in enumerate(_KINDS.values()) for word in words.split()}
_HIDE = len(_KINDS)
_BITS = _HIDE + 1
_MARK = "\ue000"  # marks the main text of generated pages


class Nodes(NamedTuple):
    """The nodes of some pages in document order."""

    parent: list[int]
    end: list[int]  # one beyond the last node of the subtree
    depth: list[int]
    tag: list[int]
    bits: list[int]  # kinds of attribute tokens
    links: list[int]  # characters of link text
    text: list[str | None]  # of a text block
    page: list[int]


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """Places of quotes and ``>``, and for each of them, met outside a quotation, where the tag ends (-1: never)."""
    marks = [m.start() for m in re.finditer("[\"'>]", html)]
    ends = [-1] * (len(marks) + 2)
    after = {'"': len(marks), "'": len(marks)}  # the next quote of each kind
    for k in reversed(range(len(marks))):
        c = html[marks[k]]
        if c == ">":
            ends[k] = marks[k] + 1
        else:
            ends[k] = ends[after[c] + 1]
            after[c] = k
    return marks, ends


def parse(html: str, page: int, out: Nodes) -> None:
    """Append a page's nodes."""
    parent, end, depth, tags, bits, links, texts, pages = out
    root = len(parent)

    def add(up: int, deep: int, tag: int, bit: int, text: str | None, linked: int) -> int:
        parent.append(up)
        end.append(len(parent))
        depth.append(deep)
        tags.append(tag)
        bits.append(bit)
        links.append(linked)
        texts.append(text)
        pages.append(page)
        return len(parent) - 1

    add(-1, 0, _GROUP["body"], 0, None, 0)
    stack: list[tuple[str, int]] = [("", root)]
    names = {"": 1}
    pieces: list[str] = []
    linked = 0
    in_link = False
    last = html.rfind(">")
    ends: tuple[list[int], list[int]] | None = None

    def flush() -> None:
        nonlocal linked
        if pieces:
            body = " ".join("".join(pieces).split())
            if body:
                up = stack[-1][1]
                add(up, len(stack), tags[up], 0, body, min(linked, len(body)))
            pieces.clear()
        linked = 0

    def leave() -> None:
        name, node = stack.pop()
        names[name] -= 1
        end[node] = len(parent)

    def tag_end(at: int) -> int:
        """Where the tag ends whose name ends at ``at``: past quoted values if their quotes close, else past the next ``>``."""
        nonlocal ends
        if ends is None:
            m = _TAG_END.match(html, at)
            if m is not None:
                return m.end()
            ends = _tag_ends(html)  # once for a page: no later tag scans it to its end again
        found = ends[1][bisect_left(ends[0], at)]
        return found if found >= 0 else html.find(">", at) + 1

    at, size = 0, len(html)
    match = _TOKEN.match
    while at < size:
        if at > last:
            rest = _OPEN_END.split(html[at:], maxsplit=1)[0]
            pieces.append(unescape(rest))
            if in_link:
                linked += len(pieces[-1])
            break
        m = match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if "&" in text:
                    text = unescape(text)
                pieces.append(text)
                if in_link:
                    linked += len(text)
            continue
        begin, at = at, tag_end(at)
        name = name.lower()
        if m[1]:
            if name in _INLINE:
                if name == "a":
                    in_link = False
            elif names.get(name):
                flush()
                in_link = False
                while stack[-1][0] != name:
                    leave()
                leave()
            continue
        if name in _RAW:
            close = re.compile("</" + name + r"(?:[\s/>]|\Z)", re.I).search(html, at)
            if name == "xmp":  # shown as it stands
                pieces.append(html[at : size if close is None else close.start()])
            at = size if close is None else html.find(">", close.start()) + 1 or size
            pieces.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                in_link = True
            continue
        if name in _VOID:
            pieces.append(" ")
            if name == "hr":
                flush()
            continue
        flush()
        in_link = False
        if name in _CLOSES and any(names.get(n) for n in _CLOSES[name]):
            stop = _STOPS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in _CLOSES[name]:
                    while len(stack) > k:
                        leave()
                    break
        elif stack[-1][0] == "p" or names.get("p") and stack[-1][0] not in ("td", "th", "li", "button"):
            while names.get("p"):
                leave()
        bit = 1 << _KIND["notice"] if name == "noscript" else 0
        attributes = html[begin : at - 1]
        if attributes:
            for value in _ATTRIBUTE.findall(attributes):
                for word in _PART.findall("".join(value)):
                    kind = _KIND.get(word.lower())
                    if kind is not None:
                        bit |= 1 << kind
            if _HIDDEN.search(attributes):
                bit |= 1 << _HIDE
        if len(stack) >= DEEPEST:
            leave()
        node = add(stack[-1][1], len(stack), _GROUP.get(name, _OTHER), bit, None, 0)
        stack.append((name, node))
        names[name] = names.get(name, 0) + 1
    flush()
    while stack:
        leave()


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Indices of the nodes at each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []


def features(n: Nodes) -> np.ndarray:
    parent, end, depth, tag, bits, page = (np.array(x, np.int64) for x in (n.parent, n.end, n.depth, n.tag, n.bits, n.page))
    count = len(parent)
    at = np.arange(count)
    is_text = np.array([t is not None for t in n.text])
    full = [t or "" for t in n.text]
    raw = [t.encode("utf-8", "surrogatepass") for t in full]
    own = np.array([[len(t), t.count(" ") + 1 if t else 0, sum(map(t.count, ".,!?;:。、")), len(b) - len(b.translate(None, _UPPER))] for t, b in zip(full, raw)], float).reshape(count, 4)
    own = np.concatenate([own, np.array(n.links, float)[:, None], is_text[:, None], 1.0 - is_text[:, None], ((own[:, 1] >= 12) & is_text)[:, None]], 1)
    sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, 0)])
    sub = sums[end] - sums[at]
    chars, words, stops, upper, linked, blocks, elements, long = sub.T
    up = np.maximum(parent, 0)
    root = np.searchsorted(page, page)  # of each node's page
    total = chars[root]
    kids = np.bincount(up[parent >= 0], minlength=count)
    by = np.lexsort((at, parent))
    place = np.empty(count)
    place[by] = np.arange(count) - np.searchsorted(parent[by], parent[by])
    siblings = np.where(parent >= 0, kids[up], 1)
    left, right = np.zeros(count), np.zeros(count)
    same = parent[by][1:] == parent[by][:-1]
    left[by[1:][same]] = chars[by[:-1][same]]
    right[by[:-1][same]] = chars[by[1:][same]]
    tags = np.zeros((count, _OTHER + 1), bool)
    tags[at, tag] = True
    kinds = (bits[:, None] >> np.arange(_BITS)) & 1 > 0
    own_flags = np.concatenate([tags, kinds], 1)
    above = np.zeros_like(own_flags)
    for level in _levels(depth)[1:]:
        above[level] = above[up[level]] | own_flags[up[level]]
    share = lambda a, b: a / np.maximum(b, 1)
    density = share(linked, chars)
    columns = [
        is_text, depth, np.log1p(chars), share(words, blocks), density, share(stops, words), share(upper, chars), np.log1p(blocks), share(chars, elements), place, siblings, share(place, siblings),
        share(sums[at, 0] - sums[root, 0], total), share(chars, total), share(chars[up], total), share(chars, chars[up]), density[up], np.log1p(left), np.log1p(right), share(long, blocks), share(long[up], blocks[up]), kids, share(words[up], blocks[up]),
    ]
    return np.concatenate([np.stack([np.asarray(c, float) for c in columns], 1), own_flags, above], 1)


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely labels of which no false node has a true descendant."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    levels = _levels(depth)
    with_, without = yes.copy(), no.copy()  # of the best labelling of each subtree
    for level in reversed(levels[1:]):
        np.add.at(with_, parent[level], np.maximum(with_[level], without[level]))
        np.add.at(without, parent[level], without[level])
    out = with_ > without
    for level in levels[1:]:
        out[level] &= out[parent[level]]
    return out


_SYLLABLES = "ba co di er fu ga hi jo ka lu me no pi ra so te un ve wi xa yo za ch th st le on an en ou ré ñe ßü шо да 中 字".split()


def _words(r: random.Random, n: int) -> str:
    made = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
    for i in range(r.randint(4, 14), n, r.randint(5, 14)):
        made[i - 1] += r.choice([".", ".", ",", "!", "?", ";"])
    return (" ".join(made).capitalize() + r.choice(["", ".", ".", "."])) if made else ""


#: Words of a paragraph.
LENGTHS = [1, 2, 3, 6, 12, 25, 40, 80, 150]


def training_page(r: random.Random) -> str:
    """A page of a random layout; its main text carries marks."""
    plain = r.random() < 0.3  # without attributes

    def box(tags: str, kind: str, body: str) -> str:
        tag = r.choice(tags.split())
        words = r.sample(_KINDS[kind].split(), 1) + r.choices(["box", "wrap", "inner", "col", "x1", "block", "area", "list", "item"], k=r.randint(0, 2))
        r.shuffle(words)
        attribute = f' {r.choice(["class", "class", "id", "role"])}="{r.choice(["-", " ", "_"]).join(words)}"'
        bare = plain and tag not in ("div", "section", "p", "ul", "table")
        return f"<{tag}{'' if bare or r.random() < 0.15 and tag != 'div' else attribute}>{body}</{tag}>"

    def items(n: int) -> str:
        rows = "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 6))}</a></li>' for i in range(n))
        return f"<ul>{rows}</ul>" if r.random() < 0.7 else " | ".join(f'<a href="#{i}">{_words(r, r.randint(1, 4))}</a>' for i in range(n))

    def prose(n: int, mark: str = "", lengths: list[int] = LENGTHS) -> list[str]:
        out = []
        for _ in range(n):
            body = mark + _words(r, r.choice(lengths))
            if lengths is LENGTHS and r.random() < 0.2:
                body += f' <a href="/x">{_words(r, r.randint(1, 5))}</a> {_words(r, r.randint(0, 12))}'
            if r.random() < 0.15:
                body = f"<b>{body}<br>"
            out.append(f"<p>{body}</p>" if r.random() < 0.85 else f"<p>{body}")
        return out

    def comments() -> str:
        rows = "".join(box("div li article", "comment", f"<b>{_words(r, 2)}</b> " + "".join(prose(r.randint(1, 3)))) for _ in range(r.randint(1, 6)))
        return box("section div div ol", "comment", f"<h3>{_words(r, r.randint(1, 3))}</h3>" + rows)

    def form() -> str:
        return box("form", "form", f"<p>{_words(r, r.randint(2, 12))}</p><label>{_words(r, 2)}</label><input><button>{_words(r, r.randint(1, 3))}</button>")

    def side() -> str:
        return box("aside div aside", "side", f"<h3>{_words(r, 2)}</h3>" + items(r.randint(2, 8)) + ("".join(prose(r.randint(1, 2))) if r.random() < 0.4 else ""))

    def notice() -> str:
        return box("div div section dialog aside p", "notice", _words(r, r.randint(6, 40)) + (f" <button>{_words(r, 1)}</button>" if r.random() < 0.5 else ""))

    brief = r.random() < 0.15
    main = prose(r.choice([1, 1, 2]) if brief else r.choice([1, 2, 3, 5, 8, 14, 25]), _MARK, [1, 2, 4, 8] if brief else LENGTHS)
    if r.random() < 0.25:
        main.insert(r.randint(0, len(main)), "<ul>" + "".join(f"<li>{_MARK}{_words(r, r.randint(2, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
    if r.random() < 0.2:
        main.insert(r.randint(0, len(main)), f"<blockquote>{_MARK}{_words(r, 20)}</blockquote>")
    if r.random() < 0.1:
        main.insert(r.randint(0, len(main)), "<table>" + "".join(f"<tr><td>{_MARK}{_words(r, 2)}</td><td>{_MARK}{_words(r, 4)}</td></tr>" for _ in range(3)) + "</table>")
    for _ in range(r.choice([0, 0, 1, 2])):
        main.insert(r.randint(0, len(main)), f"<h{(k := r.randint(2, 4))}>{_MARK}{_words(r, r.randint(1, 9))}</h{k}>")
    if r.random() < 0.75:
        main.insert(0, f"<h1>{_MARK}{_words(r, r.randint(1, 12))}</h1>")

    def ad() -> str:
        kind = r.random()
        body = "".join(prose(r.randint(1, 2))) if kind < 0.35 else _words(r, r.randint(3, 60)) if kind < 0.7 else f'<a href="/b">{_words(r, r.randint(3, 20))}</a>'
        return box("div div aside ins" if kind < 0.35 else "div div aside p ins", "ad", body)

    share = lambda: box("div ul p", "share", items(r.randint(2, 5)))
    for extra in [e for e, p in ((ad, 0.35), (share, 0.25), (side, 0.15), (notice, 0.12), (form, 0.12), (comments, 0.1)) if r.random() < p]:
        main.insert(len(main) if extra is comments else r.randint(0, len(main)), extra())
    inner = "".join(main)
    article = box("article article main section div div", "good", inner) if not plain else r.choice(["<article>{}</article>", "<main>{}</main>", "<article>{}</article>"]).format(inner)
    if r.random() < 0.18:
        article = inner  # no wrapper at all
    elif r.random() < 0.35:
        inside = "".join(x() for x, p in ((side, 0.4), (comments, 0.25), (form, 0.15)) if r.random() < p)
        article = box("div main main section", "good", article + inside)

    head = box("header header div", "head", (f"<h2>{_words(r, 2)}</h2>" if r.random() < 0.5 else "") + f'<a href="/">{_words(r, 2)}</a> {_words(r, r.randint(0, 12))}' + (box("nav ul div", "nav", items(4)) if r.random() < 0.4 else ""))
    nav = box("nav nav div", "nav", items(r.randint(3, 10)))
    foot = box("footer footer div", "foot", f"&copy; {_words(r, r.randint(1, 25))} &middot; " + (items(r.randint(2, 5)) if r.random() < 0.6 else _words(r, r.randint(1, 20))))
    before = [x for p, x in ((0.6, head), (0.8, nav), (0.3, notice()), (0.4, ad()), (0.2, side()), (0.15, form())) if r.random() < p]
    after = [x for p, x in ((0.4, side()), (0.35, comments()), (0.25, form()), (0.25, share()), (0.3, ad()), (0.25, notice())) if r.random() < p]
    r.shuffle(after)
    after += [foot] if r.random() < 0.8 else []
    if r.random() < (0.3 if article == inner else 0.06):
        before, after = [], []  # the text and nothing else
    body = "".join([*before, article, *after])
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.8 else "")


def empty() -> Nodes:
    return Nodes([], [], [], [], [], [], [], [])


def train(pages: int = 1600, seed: int = 7) -> gbt.Trees:
    """Trees trained on generated pages, in a few seconds."""
    r = random.Random(seed)
    nodes = empty()
    for i in range(pages):
        parse(training_page(r), i, nodes)
    marked = np.concatenate([[0], np.cumsum([t is not None and _MARK in t for t in nodes.text])])
    label = (marked[np.array(nodes.end)] - marked[:-1] > 0).astype(float)
    clean = nodes._replace(text=[t if t is None else t.replace(_MARK, "") for t in nodes.text])
    return gbt.fit(features(clean), label, trees=90)


STORED = Path(__file__).with_name("trees.json")


def store(trees: gbt.Trees) -> None:
    """Write the trees beside this module: ``python -c "from trigrove.llm import htmltext as h; h.store(h.train())"``."""
    rows = [f'"prior": {trees.prior!r}'] + [f'"{name}": {json.dumps(getattr(trees, name).tolist())}' for name in ("feature", "cut", "leaf")]
    STORED.write_text("{" + ",\n".join(rows) + "}\n")


@lru_cache(1)
def model() -> gbt.Trees:
    """The stored trees."""
    held = json.loads(STORED.read_text())
    return gbt.Trees(np.array(held["feature"], np.int64), np.array(held["cut"]), np.array(held["leaf"]), held["prior"])


def main_texts(htmls: list[str | None], trees: gbt.Trees) -> list[str]:
    """The main text of each page."""
    nodes = empty()
    for i, html in enumerate(htmls):
        parse(html or "", i, nodes)
    out: list[list[str]] = [[] for _ in htmls]
    if not nodes.parent:
        return [""] * len(htmls)
    keep = decode(trees.log_odds(features(nodes)), np.array(nodes.parent), np.array(nodes.depth))
    for i in np.flatnonzero(keep).tolist():
        body = nodes.text[i]
        if body is not None:
            out[nodes.page[i]].append(body)
    return ["\n".join(x) for x in out]


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``text`` and ``n_chars`` of each page, with the columns ``keep``."""
    carried = [c for c in ([c for c in pages.columns if c != html] if keep is None else keep) if c not in ("text", "n_chars")]
    types = dict(pages.dtypes)
    safe = [f"__c{i}" for i in range(len(carried))]
    trees = model()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # about PART_BYTES of pages at once
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
                part = batch.slice(at, to - at)
                found = main_texts(part.column(part.num_columns - 1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*safe, "text", "n_chars"])
                at = to

    schema = ", ".join([f"{s} {types[c]}" for s, c in zip(safe, carried)] + ["text string", "n_chars long"])
    return pages.select(*(F.col(f"`{c}`").alias(s) for s, c in zip(safe, carried)), F.col(html).alias("__html")).mapInArrow(apply, schema).toDF(*carried, "text", "n_chars")
