"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree.  Each is content or not; features of the element (tag, words of its class,
id and role, amount of text, links, punctuation) give its own potential, and each parent and child share a potential
for agreement that depends on what the child looks like.  Sum-product messages, upward from the leaves and downward
from the root, give exact marginals, and the text of elements more likely content than not is the main text.

Weights maximise the likelihood of labelled pages: pages written out here with each part marked as content or
not, and at most `max_fit_pages` pages of the table that have exactly one article or main element, whose parts are then
labelled by it.

A block's text has character references decoded and white space (as Unicode has it) turned into single spaces; blocks are joined by
one newline in page order, and empty ones dropped.  Inline elements and <br> belong to their block.

Edge cases: null and empty pages give the empty text; pages without markup are one block; broken markup is closed as
browsers do for paragraphs, list items and table parts, and by the end of the page; repeated rows are extracted each for itself;
further columns are ignored; an empty table gives an empty result; pages of any length are read whole.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names from the HTML standard and common class words, fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
NO_PARAGRAPH = BLOCKS - {"body", "button", "dd", "dt", "head", "html", "iframe", "label", "legend", "li", "noscript", "option", "select", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr"}
AGAINST = frozenset(
    "ad ads advert advertisement advertising adverts alert aside author-box banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus foot footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification paywall popular popup promo promoted promotion recommended related replies reply respond response responses search sharing side sidebar signup skyscraper social sponsor sponsored subscribe subscription tags toc toolbar trending widget".split()
)
FOR = frozenset("article articlebody body content copy entry main maintext post story text".split())
TAGS = (
    ("nav", "menu", "search"), ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "legend", "label", "select", "option", "button", "textarea", "dialog"), ("article", "main"),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("p",), ("ul", "ol", "dl", "dir"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("div", "section", "center", "details", "summary", "address"),
    ("pre", "blockquote"), ("figure", "figcaption"), ("head", "noscript", "iframe"), ("html", "body"),
)
_TAG_AT = {t: i for i, group in enumerate(TAGS) for t in group}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|title|svg|template)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest2>[^>]*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    against: bool = False
    favour: bool = False
    label: int | None = None
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    segments: list[tuple[int, str]]  # (node, text) in page order


def parse(source: str) -> Page:
    """Tree of block elements, and the pieces of text between block edges."""
    nodes, stack = [Node("html", -1)], [0]
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
    segments: list[tuple[int, str]] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = nodes[stack[-1]]
                segments.append((stack[-1], text))
                node.chars += len(text)
                node.link_chars += min(linked, len(text))
                node.stops += sum(text.count(c) for c in ".,;!?")
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text)

    def close(names: set[str], until: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of `names`, unless one of `until` is inside it."""
        last = max((where[n][-1] for n in names if where[n]), default=0)
        if last > max((where[n][-1] for n in until if where[n]), default=0):
            flush()
            for i in stack[last:]:
                where[nodes[i].tag].pop()
            del stack[last:]

    place, in_link = 0, 0
    for m in _TOKEN.finditer(source):
        add(source[place : m.start()])
        place = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, rest = m["end"] if m["tag"] else m["end2"], m["rest"] if m["tag"] else m["rest2"]
        if tag not in BLOCKS:
            if tag == "a":
                in_link = 0 if end else 1
            elif tag == "br" or tag == "img":
                pieces.append(" ")
            continue
        in_link = 0
        if end:
            close({tag}, frozenset())
            continue
        if tag == "html" or (tag == "body" and where["body"]):
            continue
        flush()
        if tag in NO_PARAGRAPH:
            close({"p"}, {"button", "td", "th", "table", "body"} | ({"div", "li", "article", "section"} - {tag}))
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES[tag])
        if tag == "body":
            close({"head"}, frozenset())
        if tag in VOID:
            continue
        node = Node(tag, stack[-1])
        parent = nodes[stack[-1]]
        node.label = parent.label
        for name, *values in _ATTRIBUTE.findall(rest):
            value = next((v for v in values if v), "")
            if name.lower() == "data-label":
                node.label = int(value == "1")
                continue
            words = {w.lower() for w in _WORD.findall(value)}
            node.against |= not words.isdisjoint(AGAINST)
            node.favour |= not words.isdisjoint(FOR)
        nodes.append(node)
        parent.children.append(len(nodes) - 1)
        where[tag].append(len(stack))
        stack.append(len(nodes) - 1)
    add(source[place:])
    flush()
    return Page(nodes, segments)


N_OWN = len(TAGS) + 9
N_PAIR = 4


def described(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of each node, and of its link to its parent."""
    n = len(page.nodes)
    total = np.array([[v.chars, v.link_chars, v.stops] for v in page.nodes], float)
    own_text = total[:, 0].copy()
    for i in range(n - 1, 0, -1):  # children stand after their parents
        total[page.nodes[i].parent] += total[i]
    own, pair = np.zeros((n, N_OWN)), np.zeros((n, N_PAIR))
    whole = max(1.0, total[0, 0])
    for i, v in enumerate(page.nodes):
        at = _TAG_AT.get(v.tag, 12)
        own[i, at] = 1
        against = v.against or at in (0, 2, 3, 4)
        favour = (v.favour and not v.against) or at == 5
        chars = total[i, 0]
        links = total[i, 1] / max(1.0, chars)
        own[i, len(TAGS) :] = [1, against, favour, math.log1p(chars) / 6, links, min(1.0, 10 * total[i, 2] / max(1.0, chars)), chars / whole, own_text[i] > 0, 0 < chars < 40]
        pair[i] = [1, against, favour, own_text[i] > 0]
    return own, pair


@dataclass
class TreeModel:
    own: np.ndarray
    pair: np.ndarray

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content: sum-product upward, then downward."""
        f, g = described(page)
        unary, agree = (f @ self.own).tolist(), (g @ self.pair).tolist()
        n = len(page.nodes)
        up, inside = [0.0] * n, list(unary)  # log-odds that a child sends its parent; own plus children's
        parents = [v.parent for v in page.nodes]
        for i in range(n - 1, 0, -1):
            up[i] = _pass(inside[i], agree[i])
            inside[parents[i]] += up[i]
        full = list(inside)
        for i in range(1, n):
            full[i] = inside[i] + _pass(full[parents[i]] - up[i], agree[i])
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in full]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        p = self.marginals(page)
        return "\n".join(text for node, text in page.segments if p[node] > 0.5) or _likeliest(page, p)


def _likeliest(page: Page, p: list[float]) -> str:
    """Where no element is likelier content than not: the subtree around the likeliest text outside of all clutter, as far up as it holds none; empty if all text is clutter."""
    clutter = [False] * len(page.nodes)
    for i, v in enumerate(page.nodes):
        clutter[i] = v.against or _TAG_AT.get(v.tag, 12) in (0, 2, 3, 4) or (v.parent >= 0 and clutter[v.parent])
    own = [node for node, _ in page.segments if not clutter[node]]
    if not own:
        return ""
    mixed = list(clutter)  # whether an element holds clutter
    for i in range(len(page.nodes) - 1, 0, -1):
        mixed[page.nodes[i].parent] |= mixed[i]
    top = max(own, key=lambda i: (p[i], -i))
    while page.nodes[top].parent > 0 and page.nodes[page.nodes[top].parent].tag not in ("body", "html") and not mixed[page.nodes[top].parent]:
        top = page.nodes[top].parent
    inside = [False] * len(page.nodes)
    for i in range(top, len(page.nodes)):
        inside[i] = i == top or (page.nodes[i].parent >= top and inside[page.nodes[i].parent])
    return "\n".join(text for node, text in page.segments if inside[node])


def _pass(odds: float, agree: float) -> float:
    """Log-odds at the other end of a link on which both ends agree with weight exp(agree), else exp(-agree)."""
    odds, agree = max(-60.0, min(60.0, odds)), max(-30.0, min(30.0, agree))
    return _log_sum(odds + agree, -agree) - _log_sum(odds - agree, agree)


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def learn(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> TreeModel:
    """Weights of greatest penalised likelihood.  pages: (own features, link features, parents, labels) of each page.

    The gradient is what is observed less what sum-product expects, for all trees at once, one level at a time.
    """
    sizes = np.cumsum([0, *(len(p[3]) for p in pages)])
    f, g = np.concatenate([p[0] for p in pages]), np.concatenate([p[1] for p in pages])
    parent = np.concatenate([np.where(p[2] < 0, -1, p[2] + s) for p, s in zip(pages, sizes, strict=False)])
    y = np.concatenate([p[3] for p in pages]).astype(float)
    depth = np.zeros(len(y), np.int64)
    for i in np.flatnonzero(parent >= 0):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    sign = 2 * y - 1
    same = sign[child] * sign[parent[child]]

    def message(odds: np.ndarray, agree: np.ndarray) -> np.ndarray:
        return np.logaddexp(odds + agree, -agree) - np.logaddexp(odds - agree, agree)

    w, first, second = np.zeros(N_OWN + N_PAIR), 0.0, 0.0
    for t in range(1, steps + 1):
        inside, agree, up = f @ w[:N_OWN], g @ w[N_OWN:], np.zeros(len(y))
        for at in reversed(levels):
            up[at] = message(inside[at], agree[at])
            np.add.at(inside, parent[at], up[at])
        full = inside.copy()
        for at in levels:
            full[at] = inside[at] + message(full[parent[at]] - up[at], agree[at])
        p = 1 / (1 + np.exp(-np.clip(full, -60, 60)))
        a, b, j = full[parent[child]] - up[child], inside[child], agree[child]
        together, apart = np.logaddexp(a + b + j, j), np.logaddexp(a - j, b - j)
        slope = np.concatenate([f.T @ (y - p), g[child].T @ (same - np.tanh((together - apart) / 2))]) / len(y) - ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return TreeModel(w[:N_OWN], w[N_OWN:])


def labelled_pages(n: int = 480, seed: int = 6) -> list[str]:
    """Pages of varied make whose parts carry data-label: 1 content, 0 not."""
    rng = random.Random(seed)
    vocabulary = "river stone window market garden letter winter paper silver engine harbour valley music copper table story north bridge field shadow".split()

    def words(a: int, b: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(a, b)))

    def prose(a: int = 1, b: int = 5) -> str:
        return " ".join(words(4, 18).capitalize() + rng.choice(".?!..") for _ in range(rng.randint(a, b)))

    def menu() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(rng.randint(3, 8))) + "</ul>"

    def clutter() -> str:
        kinds = [
            lambda: f"<nav>{menu()}</nav>", lambda: f'<div class="{rng.choice(["menu", "navbar", "breadcrumbs"])}">{menu()}</div>',
            lambda: f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", lambda: f'<div id="header"><a href="/">{words(1, 3)}</a></div>',
            lambda: f"<aside><h3>{words(1, 3)}</h3>{menu()}<p>{prose(1, 2)}</p></aside>", lambda: f'<div class="sidebar"><p>{prose(1, 3)}</p>{menu()}</div>',
            lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo banner"])}">{prose(1, 3)}</div>', lambda: f'<section class="ad"><p>{prose(1, 2)}</p></section>',
            lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "newsletter", "popup"])}"><p>{prose(1, 2)}</p><button>{words(1, 2)}</button></div>',
            lambda: f"<form action='/s'><p>{words(2, 5)}</p><label>{words(1, 2)}</label><input name=q><button>{words(1, 1)}</button></form>",
            lambda: f"<footer><p>&copy; {prose(1, 2)}</p></footer>", lambda: f'<div id="footer">&copy; {prose(1, 2)}</div>', lambda: f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 3)}</footer>",
            lambda: f'<section class="comments"><h2>{words(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            lambda: f'<ol id="comments">' + "".join(f"<li><p>{prose()}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>",
            lambda: f'<div class="related"><h3>{words(1, 3)}</h3>{menu()}</div>', lambda: f'<div role="alert">{prose(1, 2)}</div>',
        ]
        return f'<div data-label="0">{rng.choice(kinds)()}</div>' if rng.random() < 0.2 else re.sub(r"^<(\w+)", r'<\1 data-label="0"', rng.choice(kinds)())

    def links() -> str:
        return f"<{(tag := rng.choice(['ul', 'ol']))}>" + "".join(f'<li><a href="/{i}">{words(1, 6).capitalize()}</a></li>' for i in range(rng.randint(1, 5))) + f"</{tag}>"

    def block() -> str:
        kinds = [lambda: f"<p>{prose()}</p>"] * 8 + [
            lambda: f"<h2>{words(1, 6)}</h2>", lambda: "<ul>" + "".join(f"<li>{prose(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", lambda: f"<blockquote><p>{prose()}</p></blockquote>",
            lambda: f"<div>{prose()}</div>", lambda: f"<p>{words(1, 2)}.</p>", lambda: f"<pre>{words(3, 9)}</pre>", links, links, lambda: f'<p>{words(2, 6)} <a href="/x">{words(1, 4)}</a> {words(1, 5)}.</p>', lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<section><h3>{words(1, 4)}</h3><p>{prose()}</p></section>",
        ]
        return rng.choice(kinds)()

    pages = []
    for _ in range(n):
        if rng.random() < 0.35:  # a short article
            parts = [f"<h1>{words(1, 5)}</h1>"] * (rng.random() < 0.4) + [f"<p>{prose(1, 2)}</p>" for _ in range(rng.randint(1, 3))] + [links()] * (rng.random() < 0.3)
        else:
            parts = [f"<h1>{words(1, 8)}</h1>"] * (rng.random() < 0.8) + [block() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12]))]
        bare_text = rng.random() < 0.12  # sentences and line breaks without elements, or one short paragraph
        if bare_text:
            parts = [f"<h1>{words(1, 5)}</h1>"] * (rng.random() < 0.6) + [rng.choice(["<br><br>", "<br>"]).join(prose(1, 2) for _ in range(rng.randint(1, 4)))] if rng.random() < 0.6 else [f"<p>{words(3, 7).capitalize()}.</p>"]
        for _ in range(0 if bare_text else rng.choice([0, 0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), clutter())
        bare = [("div", "div"), (f'div class="{rng.choice(["wrap", "container", "share-story", "page", "col-8", "inner", "layout row", "x1"])}"', "div"), (f'section id="{rng.choice(["s1", "middle", "center"])}"', "section")]
        open_, close_ = rng.choice([("article", "article")] * 4 + [("main", "main"), ('div class="content"', "div"), ('div id="post"', "div"), ('div class="entry-content"', "div")] + bare * 2)
        body = [clutter() for _ in range(rng.randint(0, 3))] + [f'<{open_} data-label="1">' + "".join(parts) + f"</{close_}>"] + [clutter() for _ in range(rng.randint(0, 3))]
        pages.append(f"<html><head><meta charset=utf-8></head><body data-label='0'>{''.join(body)}</body></html>")
    return pages


def self_labelled(page: Page) -> list[int] | None:
    """Labels of a page with exactly one article or main element: what is inside it, but for marked clutter."""
    roots = [i for i, v in enumerate(page.nodes) if v.tag in ("article", "main")]
    if len(roots) != 1:
        return None
    labels = [0] * len(page.nodes)
    for i in range(roots[0], len(page.nodes)):
        v = page.nodes[i]
        labels[i] = int(i == roots[0] or (v.parent > 0 and labels[v.parent] and not v.against and _TAG_AT.get(v.tag, 12) not in (0, 2, 3, 4)))
    return labels


def _row(page: Page, labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*described(page), np.array([v.parent for v in page.nodes]), np.array(labels))


def fit(pages: DataFrame, max_fit_pages: int = 400, max_fit_nodes: int = 2000) -> TreeModel:
    """Learn from the labelled pages here and from a bounded sample of the table: at most about `max_fit_pages`
    self-labelled pages, of at most `max_fit_nodes` elements each.  Every page is extracted, whatever its size."""
    rows = [_row(page, [v.label or 0 for v in page.nodes]) for page in map(parse, labelled_pages())]
    share = min(1.0, max_fit_pages / max(1, pages.count()))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                page = parse(source)
                labels = self_labelled(page)
                if labels is not None and len(labels) <= max_fit_nodes:
                    kinds = ("<f4", "<f4", "<i4", "<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(_row(page, labels), kinds, strict=True)], list("fgpy"))

    picked = pages.where(F.pmod(F.xxhash64("page_id", F.lit(6)), F.lit(1_000_000)) < int(share * 1_000_000)).where("html is not null").select("html")
    for r in picked.mapInArrow(labelled, "f binary, g binary, p binary, y binary").collect():  # the bounded sample
        rows.append((np.frombuffer(r["f"], "<f4").reshape(-1, N_OWN).astype(float), np.frombuffer(r["g"], "<f4").reshape(-1, N_PAIR).astype(float), np.frombuffer(r["p"], "<i4").astype(np.int64), np.frombuffer(r["y"], "<i4").astype(np.int64)))
    return learn(rows)


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """page_id, url, text of each page.  One pass; nothing is shuffled."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id long, url string, text string")
