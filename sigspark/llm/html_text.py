"""Main text of web pages: gradient-boosted trees over the nodes of the document tree, and a hierarchical decoding.

A page becomes a tree of elements and of text runs (the text between two block boundaries of one element). Each node has features of its
subtree (text, density, links, punctuation), its attribute tokens, its depth and its siblings, and the trees give the probability that
it holds main text. The decoding picks the likeliest set of nodes in which a node is kept only if its parent is, so that
no kept run stands in a dropped subtree; the texts of the kept runs are the page's main text.

Pages carry no labels, so the trees are fitted to TRAINING_PAGES pages that `training_page` writes, whose main text is known.
Text runs end at the tags of block elements and at br and hr. Inline elements, images and other void elements, and what is left out amid a line
(select, button, svg and the like) neither end a run nor split a word: a<img>b reads ab. What is left out goes to its own end tag, nested ones of its kind counted, but no
further than the end tag of the block it stands in or, except for drawings and formulas, the start of a section: an unclosed button or object costs its block's rest, not the page.
Defined results: null, empty and textless pages give the empty text; very long pages are read whole; an empty table gives an empty result; broken markup is read as far as browsers would; rows that
repeat give equal results; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches
from .boosting import Trees, boost

TRAINING_PAGES, SEED = 500, 8
#: Nesting that is followed; what is deeper counts as lying at this depth.
MAX_DEPTH = 200
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNREAD = frozenset("head script style noscript template textarea select option button svg math iframe object canvas audio video title datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
#: Of what is left out, the kinds that hold others of their kind, and those in which the start of a section is nothing but their content.
NESTED, DRAWN = frozenset("svg math object canvas audio video".split()), frozenset(("svg", "math"))
SECTIONS = frozenset("main article section nav aside header footer".split())
#: Elements that end when one of the others begins, up to the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
HOLDS = frozenset("body div section article main aside nav header footer form table td th li ul ol dl dd blockquote figure fieldset details".split())
TAGS = "#text p div section article main aside nav header footer form ul ol li dl dd table tr td h1 h2 h3 h4 blockquote pre figure figcaption body address details".split()
#: Tokens in class, id and role that speak for and against main text.
GOOD = ("article", "content", "main", "post", "entry", "story", "body", "text", "page", "blog", "prose")
BAD = (
    ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "skip"),
    ("header", "masthead", "top", "logo", "brand"),
    ("footer", "foot", "copyright", "legal", "bottom"),
    ("side", "sidebar", "widget", "rail", "related", "recommend", "popular", "trending", "more", "tags", "author", "meta"),
    ("ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "affiliate", "outbrain"),
    ("cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "message", "subscribe", "newsletter", "signup", "paywall"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reader"),
    ("share", "social", "follow", "login", "search", "form", "contact", "tools"),
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|data-main)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "text", "attrs", "linked", "chars", "link_chars", "runs", "marks", "elements", "place", "index")

    def __init__(self, tag: str, parent: Node | None, attrs: dict | None = None):
        self.tag, self.parent, self.attrs = tag, parent, attrs or {}
        self.depth = min(MAX_DEPTH, parent.depth + 1) if parent else 0
        self.children: list[Node] = []
        self.text, self.linked, self.place = "", 0, 0
        if parent:
            self.place = len(parent.children)
            parent.children.append(self)


def parse(page: str) -> Node:
    """The tree of elements and text runs; inline elements are part of their runs."""
    root = Node("body", None)
    at, parts, link, linked = root, [], 0, 0
    pos, end = 0, len(page)
    unread, level = "", 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                run = Node("#text", at)
                run.text, run.linked = text, min(linked, len(text))
            parts, linked = [], 0

    def add(s: str):
        nonlocal linked
        if unread:
            return
        parts.append(s)
        if link:
            linked += len(s.strip())

    def holds(tag: str) -> bool:
        up = at
        while up.parent and up.tag != tag:
            up = up.parent
        return up.tag == tag and up.parent is not None

    while pos < end:
        m = _TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if unread and (closing or tag not in RAW):
            if tag == unread:
                level += -1 if closing else tag in NESTED and not m[3].rstrip().endswith("/")
                unread = unread if level else ""
                continue
            if tag in INLINE or tag in VOID or not (holds(tag) if closing else tag in SECTIONS and unread not in DRAWN):
                continue
            unread = ""
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue
        if tag in UNREAD and not closing:
            if tag in RAW:  # read up to its end tag
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                pos = stop.end() if stop else end
                continue
            if tag == "head":  # its elements are left out one by one
                continue
            if not (tag in DRAWN and m[3].rstrip().endswith("/")):
                unread, level = tag, 1
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in VOID:
            if tag in BREAKS:
                flush()
            continue
        flush()
        if closing:
            up = at
            while up.parent and up.tag != tag:
                if up.tag in HOLDS and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre"):
                    break  # a stray end tag does not end what holds it
                up = up.parent
            if up.tag == tag and up.parent:
                at, link = up.parent, 0
            continue
        if tag in ENDS:
            ended, holders = ENDS[tag]
            up = at
            while up.parent and up.tag not in ended and up.tag not in holders:
                up = up.parent
            while up.tag in ended and up.parent and (up.tag == tag or tag == "tr" or up.tag in ended and tag != "tr"):
                at = up = up.parent
        elif at.tag == "p":
            at = at.parent or root
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        at = Node(tag, at, attrs)
        if m[3].rstrip().endswith("/") and tag not in HOLDS and tag != "p":
            at = at.parent
        link = 0
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, with their subtree statistics."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.index = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(out):
        if node.tag == "#text":
            node.chars, node.link_chars, node.runs, node.elements = len(node.text), node.linked, 1, 0
            node.marks = sum(map(node.text.count, ".,;!?"))
        else:
            node.chars, node.link_chars, node.runs, node.marks, node.elements = (sum(getattr(c, k) for c in node.children) for k in ("chars", "link_chars", "runs", "marks", "elements"))
            node.elements += 1
    return out


@lru_cache(maxsize=20_000)
def _tokens(tag: str, names: str) -> tuple[float, ...]:
    words = set(_SPLIT.split(_CAMEL.sub(" ", names).lower())) - {""}
    good = float(bool(words & set(GOOD)) or any(w.startswith(("article", "content")) for w in words))
    return (good, *(float(any(w in group or len(w) > 4 and any(len(g) > 3 and w.startswith(g) for g in group) for w in words)) for group in BAD))


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node, from its subtree, attributes, depth, siblings and the path to it."""
    total = max(1, nodes[0].chars)
    rows = []
    paths: list[tuple[float, ...]] = []
    tags = [Counter(c.tag for c in node.children) for node in nodes]
    for node in nodes:
        up = node.parent
        own = _tokens(node.tag, " ".join(node.attrs.get(k, "") for k in ("class", "id", "role")))
        hidden = float("hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", "").lower())
        flags = (*own, hidden, *(float(node.tag == t) for t in ("nav", "aside", "footer", "header", "form", "article", "main", "p", "li")))
        path = tuple(map(max, flags, paths[up.index])) if up else flags
        paths.append(path)
        siblings = up.children if up else [node]
        same = tags[up.index][node.tag] if up else 1
        held = max(1, up.chars if up else node.chars)
        before = siblings[node.place - 1].chars if node.place else 0
        after = siblings[node.place + 1].chars if node.place + 1 < len(siblings) else 0
        rows.append((
            TAGS.index(node.tag) if node.tag in TAGS else len(TAGS),
            (TAGS.index(up.tag) if up.tag in TAGS else len(TAGS)) if up else -1,
            node.depth, np.log1p(node.chars), node.chars / total, node.chars / held,
            node.link_chars / max(1, node.chars), node.marks / max(1, node.chars), node.chars / (1 + node.elements), node.chars / max(1, node.runs),
            np.log1p(node.elements), len(siblings), same, node.place / len(siblings), np.log1p(before), np.log1p(after), node.index / len(nodes),
            *own, *path,
        ))
    return np.array(rows, dtype=np.float32)


def decode(nodes: list[Node], logits: np.ndarray) -> list[Node]:
    """The kept text runs, in page order: the likeliest choice in which every kept node's parent is kept."""
    z = np.clip(logits, -12, 12)
    keep, drop = -np.logaddexp(0, -z), -np.logaddexp(0, z)
    best_kept, all_dropped = keep.copy(), drop.copy()
    for node in reversed(nodes[1:]):  # children come before their parents
        i, up = node.index, node.parent.index
        all_dropped[up] += all_dropped[i]
        best_kept[up] += max(best_kept[i], all_dropped[i])
    chosen = np.zeros(len(nodes), dtype=bool)
    chosen[0] = True
    for node in nodes[1:]:
        chosen[node.index] = chosen[node.parent.index] and best_kept[node.index] > all_dropped[node.index]
    return [n for n in nodes if n.tag == "#text" and chosen[n.index]]


def training_page(rnd: random.Random) -> str:
    """A page of random words in one of many layouts; elements that hold main text say data-main=1, and parts of them that don't say 0."""

    def words(a: int, b: int) -> str:
        out = ["".join(rnd.choices("abcdefghilmnoprstuv", k=rnd.randint(1, 9))) for _ in range(rnd.randint(a, b))]
        marks = [w + rnd.choice(("", "", "", "", "", "", ",", ".")) for w in out]
        return (" ".join(marks)).capitalize() + rnd.choice((".", ".", "", "!"))

    def el(tag: str, body: str, names: str = "", main: int | None = None) -> str:
        if tag in ("nav", "aside", "header", "footer", "form") and rnd.random() < 0.4:
            names = ""  # the element says enough
        attr = rnd.choice((f' class="{names}"', f' id="{names}"', f' class="{names} {rnd.choice("abcxyz")}{rnd.randint(1, 9)}"')) if names else ""
        return f"<{tag}{attr}{'' if main is None else f' data-main={main}'}>{body}</{tag}>"

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rnd.randint(a, b))]
        return el("ul", "".join(f"<li>{i}</li>" for i in items)) if rnd.random() < 0.7 else rnd.choice((" ", " | ", "")).join(items)

    def named(group: int) -> str:
        return rnd.choice(BAD[group]) if rnd.random() < 0.8 else ""

    def paragraph() -> str:
        kind = rnd.random()
        if kind < 0.72:
            inner = words(1, 6) if rnd.random() < 0.15 else words(12, 90)
            if rnd.random() < 0.3:
                inner += f' <a href="#">{words(1, 4)}</a> {words(2, 20)}'
            if rnd.random() < 0.15:
                return f"<p><b>{inner}<br>"
            return f"<p>{inner}</p>" if rnd.random() < 0.9 else f"<p>{inner}"
        if kind < 0.8:
            return el(rnd.choice(("h2", "h3")), words(1, 8))
        if kind < 0.87:
            return el(rnd.choice(("ul", "ol")), "".join(f"<li>{words(3, 20)}</li>" for _ in range(rnd.randint(2, 6))))
        if kind < 0.92:
            return el("blockquote", rnd.choice((f"<p>{words(8, 40)}</p>", words(8, 40))))
        if kind < 0.96:
            return el("table", "".join(f"<tr><td>{words(1, 5)}</td><td>{words(1, 8)}</td></tr>" for _ in range(rnd.randint(2, 5))))
        return el(rnd.choice(("pre", "div")), words(5, 40))

    def advert(main: int | None = None) -> str:
        return el(rnd.choice(("div", "div", "aside", "section")), rnd.choice((words(2, 25), f"<p>{words(2, 30)}</p>", links(1, 4))), rnd.choice(BAD[4]), main)

    def notice(main: int | None = None) -> str:
        return el(rnd.choice(("div", "section", "p", "aside")), words(5, 35) + rnd.choice(("", '<a href="#">ok</a>', "<button>ok</button>")), rnd.choice(BAD[5]), main)

    def comments(main: int | None = None) -> str:
        one = lambda: el(rnd.choice(("div", "li", "article")), rnd.choice(("", f"<b>{words(1, 2)}</b> ")) + f"<p>{words(3, 40)}</p>", rnd.choice(("comment", "reply", "")))
        body = el("h3", words(1, 3)) + "".join(one() for _ in range(rnd.randint(1, 6)))
        return el(rnd.choice(("section", "div", "ol")), body, rnd.choice(("comments", "comment-list", "discussion", "reader-comments", "replies", "respond")), main)

    def form(main: int | None = None) -> str:
        body = rnd.choice(("", f"<label>{words(1, 3)}</label>", f"<p>{words(3, 20)}</p>")) + '<input type="text"><button>go</button>'
        return el("form", body, named(7), main)

    def aside(main: int | None = None) -> str:
        body = el(rnd.choice(("h2", "h3", "h4")), words(1, 3)) + rnd.choice((links(2, 8), f"<p>{words(5, 40)}</p>", words(4, 30)))
        return el(rnd.choice(("aside", "div", "section")), body, rnd.choice(BAD[3]) if rnd.random() < 0.8 else "sidebar", main)

    body = [f"<h1>{words(2, 10)}</h1>"] if rnd.random() < 0.8 else []
    body += [paragraph() for _ in range(rnd.choice((1, 2, 4, 6, 9, 14)))]
    for part in (advert, notice, aside, form, comments):
        if rnd.random() < 0.15:
            body.insert(rnd.randint(1, len(body)), part(0))
    if rnd.random() < 0.1:
        body.insert(0, el("header", rnd.choice((links(1, 3), words(2, 8))), named(1), 0))
    if rnd.random() < 0.1:
        body.append(el("footer", rnd.choice((links(1, 3), words(2, 8))), named(2), 0))
    shape = rnd.random()
    if shape < 0.45:
        main = el("article", "".join(body), rnd.choice(("", "", "post", "story")), 1)
    elif shape < 0.6:
        main = el("main", "".join(body), rnd.choice(("", "content")), 1)
    else:
        main = el(rnd.choice(("div", "section", "td")), "".join(body), rnd.choice(GOOD) if rnd.random() < 0.85 else "", 1)
    for _ in range(rnd.choice((0, 0, 1, 2))):
        main = el("div", main, rnd.choice(("wrap", "container", "page", "row", "layout", "")))
    if rnd.random() < 0.06:
        return f"<html><body data-x>{main}</body></html>"
    before = [el(rnd.choice(("nav", "nav", "div", "header")), links(2, 9), named(0) or "nav")]
    if rnd.random() < 0.5:
        before.insert(0, el(rnd.choice(("header", "div")), rnd.choice((el("h1", words(1, 4)), words(1, 6), links(1, 5))) + rnd.choice(("", form())), rnd.choice(BAD[1]) if rnd.random() < 0.7 else "header"))
    after = []
    for part in (advert, notice, aside, form):
        if rnd.random() < 0.4:
            (before if rnd.random() < 0.5 else after).append(part())
    if rnd.random() < 0.35:
        after.insert(0, comments())
    if rnd.random() < 0.9:
        after.append(el(rnd.choice(("footer", "footer", "div")), rnd.choice((f"&copy; {words(2, 20)}", links(2, 8), f"<p>{words(3, 25)}</p>", f"&copy; {words(1, 3)} &middot; {words(3, 25)}")), rnd.choice(BAD[2])))
    rnd.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}<!-- x -->{main}{''.join(after)}</body></html>"


def truth(nodes: list[Node]) -> np.ndarray:
    """Whether a run is main text by data-main, and whether an element holds such a run."""
    said, out = [], np.zeros(len(nodes))
    for node in nodes:
        said.append(node.attrs.get("data-main") or (said[node.parent.index] if node.parent else "0"))
        if node.tag == "#text" and said[-1] == "1":
            up = node
            while up:
                out[up.index] = 1
                up = up.parent
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    rnd = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        nodes = nodes_of(parse(training_page(rnd)))
        x.append(features(nodes))
        y.append(truth(nodes))
    return boost(np.concatenate(x), np.concatenate(y))


def main_texts(pages: list[str | None], model: Trees) -> Iterator[str]:
    trees = [nodes_of(parse(p or "")) for p in pages]
    rows = [features(t) for t in trees]
    logits = model.logits(np.concatenate(rows)) if rows else np.zeros(0)
    at = 0
    for t in trees:
        yield " ".join(n.text for n in decode(t, logits[at : at + len(t)]))
        at += len(t)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for i in range(0, b.num_rows, 100):
                texts += main_texts(b.column("html").slice(i, 100).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
