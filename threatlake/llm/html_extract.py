"""Main text of web pages by a graphical model over the tree of elements.

Every block element is content or not. A potential of its own features and one for each parent
and child make a tree-structured model; sum-product messages, leaves to root and back, give
each element's probability of being content. Both kinds of potentials are fitted, by the
gradient of the likelihood (observed less expected), to labelled pages.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake.llm.html_tree import HIDDEN, INLINE, Block, Node, blocks, parse

#: Pages that are labelled and learnt from: at most so many, chosen by a hash of the id.
LABELLED_PAGES = 250
EPOCHS, RATE, RIDGE = 12, 0.15, 1e-4
#: What the labels of a page go by: outermost elements of an article, and elements that are none of it wherever they stand.
ARTICLE = {"article", "main"}
APART = {"nav", "aside", "footer", "form", "header", "dialog", "button", "select", "textarea"}
APART_NAMES = re.compile(r"\b(ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|widget|related|share|social|cookie\w*|consent|notice|alert|newsletter|subscri\w*|comments?|repl(y|ies)|respond|footer|copyright|login|search|pagination|popup|modal|hidden)\b")


@dataclass
class Tree:
    """Block elements in page order: features, parent (-1: none) and kind of the edge to it."""

    features: list[list[int]]
    parent: list[int]
    edge: list[int]
    place: dict[int, int]  # number of the node in the page -> here


FEATURES, EDGES = 1 << 13, 64


def _feature(name: str) -> int:
    out = 2166136261
    for c in name.encode():
        out = ((out ^ c) * 16777619) & 0xFFFFFFFF
    return (out ^ out >> 15) % FEATURES


_known: dict[str, int] = {}


def _number(name: str) -> int:
    if (k := _known.get(name)) is None:
        if len(_known) > 20_000:  # names come from pages
            _known.clear()
        k = _known[name] = _feature(name)
    return k


def _level(x: float) -> int:
    return min(9, int(math.log2(1 + x)))


def as_tree(nodes: list[Node], found: list[Block]) -> Tree:
    own, linked = [0] * len(nodes), [0] * len(nodes)
    stops = [0] * len(nodes)
    for b in found:
        own[b.node] += len(b.text)
        linked[b.node] += b.linked
        stops[b.node] += sum(b.text.count(c) for c in ".!?;:")
    below, links = own[:], linked[:]
    for k in range(len(nodes) - 1, 0, -1):
        below[nodes[k].parent] += below[k]
        links[nodes[k].parent] += links[k]
    total = max(1, below[0])
    tree = Tree([], [], [], {})
    above = [-1] * len(nodes)  # the nearest block element, as a place in the tree
    gone = [False] * len(nodes)
    for k, node in enumerate(nodes):
        up = above[node.parent] if k else -1
        gone[k] = k > 0 and (gone[node.parent] or node.tag in HIDDEN)
        if gone[k] or (k and node.tag in INLINE):
            above[k] = up
            continue
        above[k] = tree.place[k] = len(tree.parent)
        parent_tag = nodes[node.parent].tag if k else ""
        names = [f"t {node.tag}", f"p {parent_tag} {node.tag}", f"l {_level(own[k])}", f"b {_level(10 * below[k] / total)}",
                 f"d {int(4 * links[k] / below[k]) if below[k] else -1}", f"s {_level(stops[k])}", "one"]
        for word in re.findall(r"[a-z]+", node.names):
            names += [f"n {word}", f"n {word[:6]}*"]
        tree.features.append([_number(x) for x in names])
        tree.parent.append(up)
        tree.edge.append(_number(f"e {node.tag}") % (EDGES - 1) + 1 if up >= 0 else 0)
    return tree


@dataclass
class Model:
    """``unary``: log-odds of content for each feature; ``pair``: for each kind of edge the weights of
    (parent, child) in (0, 0), (0, 1), (1, 0), (1, 1)."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    pair: np.ndarray = field(default_factory=lambda: np.tile([0.5, -0.5, -0.5, 0.5], (EDGES, 1)))

    def marginals(self, tree: Tree) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Probability of content of each element, and of the four states of each edge to a parent."""
        unary, pair = self._lists()
        n = len(tree.parent)
        score = [sum([unary[f] for f in own]) for own in tree.features]
        up0, up1 = [0.0] * n, score[:]  # log weights of an element and all below it
        sent = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):  # children stand behind their parents
            w = pair[tree.edge[k]]
            m = sent[k] = _log_sum(w[0] + up0[k], w[1] + up1[k]), _log_sum(w[2] + up0[k], w[3] + up1[k])
            p = tree.parent[k]
            up0[p] += m[0]
            up1[p] += m[1]
        out, states = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        full0, full1 = up0[:], up1[:]  # with what comes from above
        for k in range(n):
            if k:
                w, p = pair[tree.edge[k]], tree.parent[k]
                a, b = full0[p] - sent[k][0], full1[p] - sent[k][1]
                full0[k] += (d := _log_sum(a + w[0], b + w[2]))
                full1[k] += (e := _log_sum(a + w[1], b + w[3]))
                logs = a + w[0] + up0[k], a + w[1] + up1[k], b + w[2] + up0[k], b + w[3] + up1[k]
                top = max(logs)
                weights = [math.exp(x - top) for x in logs]
                whole = sum(weights)
                states[k] = tuple(x / whole for x in weights)
                if (shift := max(d, e)) > 500 or shift < -500:
                    full0[k] -= shift
                    full1[k] -= shift
            out[k] = 1 / (1 + math.exp(min(500.0, max(-500.0, full0[k] - full1[k]))))
        return out, states

    def _lists(self):
        if not hasattr(self, "_held"):
            self._held = self.unary.tolist(), self.pair.tolist()
        return self._held

    def __getstate__(self):
        return {"unary": self.unary, "pair": self.pair}


def _log_sum(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


def label(nodes: list[Node]) -> list[bool]:
    """For each node whether it is of the article: inside one and in nothing that stands apart."""
    out = [False] * len(nodes)
    apart = [False] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        apart[k] = apart[node.parent] or node.tag in APART or bool(APART_NAMES.search(node.names))
        out[k] = (out[node.parent] or node.tag in ARTICLE) and not apart[k]
    return out


def fit(pages: list[tuple[Tree, list[bool]]]) -> Model:
    """Stochastic gradient steps, a page at a time, each scaled by the sum of squares so far."""
    model = Model()
    size_u, size_p = np.full(FEATURES, 1e-6), np.full(model.pair.shape, 1e-6)
    order = list(range(len(pages)))
    shuffle = random.Random(7)
    for _ in range(EPOCHS):
        shuffle.shuffle(order)
        for j in order:
            tree, truth = pages[j]
            model.__dict__.pop("_held", None)
            found, states = model.marginals(tree)
            slope_u, slope_p = np.zeros(FEATURES), np.zeros(model.pair.shape)
            for k, (own, p) in enumerate(zip(tree.features, found)):
                np.add.at(slope_u, own, truth[k] - p)
                if tree.parent[k] >= 0:
                    expected = -np.array(states[k])
                    expected[2 * truth[tree.parent[k]] + truth[k]] += 1
                    slope_p[tree.edge[k]] += expected
            for value, size, slope in ((model.unary, size_u, slope_u - RIDGE * model.unary), (model.pair, size_p, slope_p - RIDGE * model.pair)):
                size += slope ** 2
                value += RATE * slope / np.sqrt(size)
    model.__dict__.pop("_held", None)
    return model


_WORDS = ("home about news contact archive login search share tweet subscribe sign up follow us more read next previous tags related comments reply privacy terms "
          "cookies accept newsletter email sponsored advertisement copyright rights reserved menu top stories popular latest").split()
_CONTENT = ['<div class="post">', '<div class="entry-content">', '<div class="article-body">', '<div id="content">', '<section class="story">', '<div class="post-content">', "<main>",
            "<article>", '<article class="post">', '<div class="content">', '<div id="main">', '<div itemprop="articleBody">', '<div class="text">', '<div class="page">', "<div>"]
_OUTSIDE = ['<header class="site-header">', '<div class="header">', '<div id="menu">', '<ul class="navbar">', "<nav>", '<div class="nav">', "<aside>", '<div class="sidebar">', '<aside class="widget">',
            '<div id="related">', '<div class="related-posts">', '<div class="cookie-notice">', '<div class="alert notice">', '<div class="banner">', '<div class="newsletter">',
            '<div class="consent">', '<div class="ad">', '<div class="advert">', '<div class="ads sponsored">', '<div class="promo">', '<form action="/s">', '<form class="login">',
            '<section id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="replies">', "<footer>", '<div class="footer">',
            '<div id="footer">', '<div class="copyright">', '<div class="share">', '<div class="social-links">', '<div class="breadcrumbs">', '<div class="pagination">', '<div role="navigation">',
            '<div role="complementary">', '<div role="banner">', '<div role="contentinfo">', '<div class="popup">', '<div class="subscribe">', "<dialog>", '<div class="user-comment">']


def _end(start: str) -> str:
    return f"</{re.match(r'<(\w+)', start)[1]}>"


def variant(texts: list[str], other: list[str], rng: random.Random) -> tuple[list[Node], list[bool]]:
    """A labelled page in another layout: blocks of an article and of what surrounds it, taken from real pages."""

    def noise() -> str:
        start = rng.choice(_OUTSIDE)
        kind, prose = rng.random(), lambda: rng.choice(other + texts) if other + texts else "x"
        if start.startswith("<form"):
            body = f"<label>{' '.join(rng.choices(_WORDS, k=2))}</label><input><p>{' '.join(rng.choices(_WORDS, k=5))}</p><button>{rng.choice(_WORDS)}</button>"
        elif kind < 0.35:
            items = "".join(f'<li><a href="/">{" ".join(rng.choices(_WORDS, k=rng.randint(1, 3)))}</a></li>' for _ in range(rng.randint(2, 8)))
            body = items if start[1:3] in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind < 0.6:
            body = " ".join(rng.choices(_WORDS, k=rng.randint(2, 12))) if start[1:3] not in ("ul", "ol") else f"<li>{rng.choice(_WORDS)}</li>"
        else:
            row = "li" if start[1:3] in ("ul", "ol") else rng.choice(["p", "div", "p"])
            body = (f"<h3>{' '.join(rng.choices(_WORDS, k=2))}</h3>" if rng.random() < 0.4 and row != "li" else "") + "".join(f"<{row}>{_escape(prose())}</{row}>" for _ in range(rng.randint(1, 4)))
        return f'<x-apart data-role="x-apart">{start}{body}{_end(start)}</x-apart>'

    body = []
    for k, text in enumerate(texts):
        tag = ("h1" if k == 0 else "h2" if len(text) < 60 and rng.random() < 0.2 else rng.choice(["p"] * 8 + ["blockquote", "li", "pre", "div", "td"]))
        cell = _escape(text)
        body.append({"li": f"<ul><li>{cell}</li></ul>", "td": f"<table><tr><td>{cell}</td></tr></table>"}.get(tag, f"<{tag}>{cell}</{tag}>"))
        if rng.random() < 0.06:
            body.append(noise())
    if rng.random() < 0.3:
        body.append(noise())
    outer = rng.sample(_CONTENT, k=rng.choice([1, 1, 2]))
    content = "".join(outer) + "".join(body) + "".join(_end(x) for x in reversed(outer))
    content = f'<x-article data-role="x-article">{content}</x-article>'
    wrap = rng.choice(["", "", '<div class="container">', '<div id="wrapper">', '<div class="row">'])
    html = f"<html><body>{wrap}{''.join(noise() for _ in range(rng.randint(1, 5)))}{content}{''.join(noise() for _ in range(rng.randint(1, 4)))}{_end(wrap) if wrap else ''}</body></html>"
    return _marked(parse(html))


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _marked(nodes: list[Node]) -> tuple[list[Node], list[bool]]:
    """Labels by the marks, and the page without them."""
    inside, apart = [False] * len(nodes), [False] * len(nodes)
    to, kept, truth = [0] * len(nodes), [], []
    for k, node in enumerate(nodes):
        if k:
            inside[k], apart[k] = inside[node.parent] or node.tag == "x-article", apart[node.parent] or node.tag == "x-apart"
        if node.tag.startswith("x-a"):
            to[k] = to[node.parent]
            continue
        to[k] = len(kept)
        kept.append(Node(node.tag, node.names, to[node.parent] if k else -1))
        truth.append(inside[k] and not apart[k])
        if k:
            kept[to[node.parent]].children.append(to[k])
    # Texts, in their order among the children.
    for node in kept:
        node.children.clear()
    stack = [(0, 0)]
    while stack:
        k, at = stack.pop()
        for i, child in enumerate(nodes[k].children[at:], at):
            if isinstance(child, str):
                kept[to[k]].children.append(child)
                continue
            if not nodes[child].tag.startswith("x-a"):
                kept[to[k]].children.append(to[child])
            stack += [(k, i + 1), (child, 0)]
            break
    return kept, truth


def learn(pages: list[str], seed: int = 11) -> Model:
    """Fit on pages labelled by their markup and on the same texts in other layouts.

    If no page has an article to go by, on such layouts of the pages' texts alone.
    """
    rng = random.Random(seed)
    trees = []
    for html in pages:
        nodes = parse(html or "")
        truth, found = label(nodes), blocks(nodes)
        texts, other = [b.text for b in found if truth[b.node]], [b.text for b in found if not truth[b.node]]
        if not texts:
            continue
        cases = [(nodes, truth), variant(texts[:40], other, rng), variant(texts[:rng.randint(1, 8)], other, rng), variant(texts[:rng.randint(1, 4)], other, rng)]
        for some, right in cases:
            tree = as_tree(some, blocks(some))
            trees.append((tree, [right[k] for k in tree.place]))
    if not trees:
        for html in pages:
            texts = [b.text for b in blocks(parse(html or ""))]
            for most in (40, 8, 4) if texts else ():
                some, right = variant(rng.sample(texts, min(len(texts), most)), texts, rng)
                tree = as_tree(some, blocks(some))
                trees.append((tree, [right[k] for k in tree.place]))
    return fit(trees)


def main_text(model: Model, html: str | None) -> str:
    """Blocks of the elements that are likelier content than not, joined by \\n."""
    nodes = parse(html or "")
    found = blocks(nodes)
    if not found:
        return ""
    tree = as_tree(nodes, found)
    likely, _ = model.marginals(tree)
    return "\n".join(b.text for b in found if likely[tree.place[b.node]] >= 0.5)


def train_on(df: DataFrame, html_col: str = "html", id_col: str = "page_id") -> Model:
    """A model from at most LABELLED_PAGES pages of ``df`` that have an article to go by, or of all if none has."""
    article = F.col(html_col).rlike("(?i)<(article|main)[ >]")
    return learn(_sample(df.where(article), html_col, id_col) or _sample(df.where(F.length(html_col) > 0), html_col, id_col))


def _sample(usable: DataFrame, html_col: str, id_col: str) -> list[str]:
    ids = usable.select(F.col(id_col)).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(LABELLED_PAGES)
    return [r[0] for r in usable.join(F.broadcast(ids), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).select(html_col).limit(LABELLED_PAGES).collect()]


def extract_pages(df: DataFrame, model: Model, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages without content, have an empty text of 0 characters.
    Character references are decoded, white space inside a block is one space, blocks follow
    each other by one \\n. Null ids and urls are kept, repeated rows are rows of their own; an
    empty table gives no rows; other columns are not read. Each page is worked on alone.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(held.value, h.as_py()) for h in part.column(2)]
                yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    narrow = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
