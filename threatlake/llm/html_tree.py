"""A page as a tree of nodes with features: what the content model works on."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Not part of what a reader sees.
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "math"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span",
          "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements whose start ends an open element of the second set, unless one of the third is between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that end an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: Elements past which an end tag or a paragraph's implied end doesn't reach.
WALLS = {"table", "td", "th", "html", "body", "article", "section", "div", "nav", "aside", "footer", "header", "main", "form"}


@dataclass
class Node:
    tag: str
    names: str = ""  # class, id, role and label, lower case
    parent: int = -1
    children: list[int | str] = field(default_factory=list)  # numbers of nodes, and texts


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.tags = [Node("#page")], [0], Counter()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end("p", WALLS)
        if tag in CLOSES:
            ended, walls = CLOSES[tag]
            while (k := self._find(ended, walls)) is not None:
                self._cut(k)
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label", "itemprop", "data-role")).lower()
        if any(k == "hidden" for k, _ in attrs) or any(k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs):
            names += " hidden"
        self.nodes.append(Node(tag, names, self.open[-1]))
        self.nodes[self.open[-1]].children.append(len(self.nodes) - 1)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._end(tag, set() if tag in WALLS else WALLS - {tag})

    def handle_data(self, data):
        self.nodes[self.open[-1]].children.append(data)

    def parse_marked_section(self, i, report=1):
        """A declaration that the parser doesn't know is a comment that ends at the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def _cut(self, k):
        for gone in self.open[k:]:
            self.tags[self.nodes[gone].tag] -= 1
        del self.open[k:]

    def _find(self, tags, walls):
        if not any(self.tags[t] for t in tags):
            return None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in tags:
                return k
            if tag in walls:
                return None
        return None

    def _end(self, tag, walls):
        if (k := self._find({tag}, walls)) is not None:
            self._cut(k)


def parse(html: str) -> list[Node]:
    """Nodes in page order, a parent before its children; node 0 is the page. Broken markup gives a tree too."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.nodes


@dataclass
class Block:
    """Text between the starts and ends of block elements, and the element it stands in."""

    node: int
    text: str
    linked: int  # code points inside links


def blocks(nodes: list[Node]) -> list[Block]:
    """The visible blocks of a page in order, white space inside them made single spaces."""
    out: list[Block] = []
    held: list[tuple[str, bool]] = []

    def close(owner: int) -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append(Block(owner, text, sum(len("".join(t.split())) for t, a in held if a)))
        held.clear()

    # (node, place among its children, the block element it is in, inside a link)
    stack = [(0, 0, 0, False)]
    while stack:
        k, at, owner, link = stack.pop()
        node = nodes[k]
        while at < len(node.children):
            child = node.children[at]
            at += 1
            if isinstance(child, str):
                held.append((child, link))
                continue
            tag = nodes[child].tag
            if tag in HIDDEN:
                continue
            if tag == "br":
                held.append((" ", link))
            elif tag in INLINE:
                stack += [(k, at, owner, link), (child, 0, owner, link or tag == "a")]
                break
            else:
                close(owner)
                stack += [(k, at, owner, link), (child, 0, child, link)]
                break
        else:
            if owner == k:
                close(k)
    return out
