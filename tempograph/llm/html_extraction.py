"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements; inline elements belong to their
block.  Each node has features of its subtree (text, density, links,
punctuation), attribute tokens (hashed into ``HASHED`` cells, and counted by
two lists), depth, siblings and place; boosted trees give the chance that its
subtree holds article text.  Decoding takes the most
likely labelling in which a dropped node drops all below it, found from the
leaves up, so an ancestor and a descendant never contradict each other.

The trees are fitted on pages that ``Maker`` builds with known article parts:
a bounded number of them (``pages``), from a fixed seed.

Null html counts as empty; a page without article text gives an empty string;
broken markup is read as far as it can be, in time linear in its length;
repeated pages each give a row, extra columns are ignored.  Scripts, styles, forms and the head never count as
text.  Character references are decoded, white space in a block becomes one
space, blocks are joined by a line feed in page order.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes

# HTML's elements by their part in a page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video", "form", "button", "select", "textarea", "input", "label", "fieldset", "option", "dialog", "menu"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "center", "details", "summary", "hgroup"}
PHRASE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}
GOOD = {"article", "content", "post", "entry", "body", "main", "text", "story", "prose", "page"}
BAD = {"nav", "navbar", "navigation", "menu", "header", "head", "masthead", "top", "topbar", "footer", "foot", "bottom", "sidebar", "side", "aside", "rail", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "related", "recommended", "share", "sharing", "social", "comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus", "subscribe", "newsletter", "signup", "login", "search", "breadcrumb", "breadcrumbs", "crumbs", "widget", "copyright", "legal", "disclaimer", "pagination", "pager", "tags", "toolbar", "contentinfo", "complementary", "skip", "hidden", "feedback", "responses"}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_VALUE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    hidden: bool = False
    gold: bool = False
    #: texts of its own and children, in page order
    content: list = field(default_factory=list)
    links: int = 0
    inputs: int = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


class Tags:
    """The tags of a page from left to right, in one pass whatever the markup.

    Quotes hold a tag open only after an equals sign.  Where a quoted value
    never ends, quotes mean nothing from there on; a tag that never ends is
    text.  So no part of a page is read more than twice.
    """

    def __init__(self, source: str):
        self.source, self.quoted = source, True
        self.last = source.rfind(">")
        self.lowered: str | None = None

    def end_of(self, at: int) -> int:
        """The place of the ``>`` that ends the tag around ``at``."""
        source, stop = self.source, -1
        while self.quoted:
            if stop < at:
                stop = source.find(">", at)
            value = _VALUE.search(source, at, stop if stop >= 0 else len(source))
            if not value:
                return stop
            close = source.find(value[1], value.end())
            if close < 0:
                self.quoted = False
            else:
                at = close + 1
                if at > self.last:
                    self.quoted = False
        return stop if stop >= at else source.find(">", at)

    def after(self, name: str, at: int) -> int:
        """The place behind the end tag of a raw element; the page's end if it has none."""
        if self.lowered is None:
            self.lowered = self.source.lower() if len(self.source.lower()) == len(self.source) else self.source
        while True:
            at = self.lowered.find("</" + name, at)
            if at < 0:
                return len(self.source)
            stop = at + 2 + len(name)
            end = self.source.find(">", stop)
            if end < 0:
                return len(self.source)
            if self.source[stop : min(end, stop + 1)].strip(" \t\r\n\f/") == "":
                return end + 1
            at = stop

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(begin, end, whether it closes, name, attributes) of each tag; comments and declarations have no name."""
        source, at = self.source, 0
        while True:
            begin = source.find("<", at)
            if begin < 0 or begin > self.last:
                return
            follows = source[begin + 1 : begin + 2]
            if source.startswith("!--", begin + 1):
                end = source.find("-->", begin + 4)
                at = len(source) if end < 0 else end + 3
                yield begin, at, False, "", ""
                continue
            if follows and follows in "!?":
                at = source.find(">", begin) + 1
                yield begin, at, False, "", ""
                continue
            closes = follows == "/"
            name = _NAME.match(source, begin + 1 + closes)
            if not name:
                at = begin + 1
                continue
            end = self.end_of(name.end())
            if end < 0:
                at = begin + 1
                continue
            at = end + 1
            lowered = name[0].lower()
            if lowered in RAW and not closes:
                at = self.after(lowered, at)
            yield begin, at, closes, lowered, source[name.end() : end]


def parse(source: str) -> list[Node]:
    """Block elements in page order, the root first; a text is kept with the block that it stands in."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, with the block that they belong to
    # where each element is open in the stack, and the blocks among them: what a tag closes is found without a search
    places: dict[str, list[int]] = {"html": [0]}
    blocks = [0]
    silent = anchor = 0
    at = 0

    def text(upto: int) -> None:
        if upto > at and not silent:
            own = nodes[stack[-1][1]]
            piece = source[at:upto]
            own.content.append(piece)
            if anchor:
                own.links += len(piece)

    def opened(name: str, block: int) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, block))

    def close(to: int) -> None:
        nonlocal silent, anchor
        while len(stack) > to:
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                blocks.pop()
            silent -= name in SILENT
            anchor -= name == "a"

    def last(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    for begin, end, closes, name, given in Tags(source):
        text(begin)
        at = end
        if not name:
            continue
        if closes:
            k = last((name,))
            if k > 0 and (name in BLOCKS or name in SILENT or k > blocks[-1]):
                close(k)
            if name in BLOCKS:
                nodes[stack[-1][1]].content.append(None)
            continue
        if name in RAW:
            continue
        if name in VOID:
            if name == "input":
                nodes[stack[-1][1]].inputs += 1
            if name in ("br", "hr"):
                nodes[stack[-1][1]].content.append(" ")
            continue
        if name in BLOCKS:
            if name in CLOSES:
                k = last(CLOSES[name])
                if k > last(WALLS[name]):
                    close(k)
            elif stack[blocks[-1]][0] in PHRASE:
                close(blocks[-1])
            if name in ("html", "body") and places.get(name):
                continue
            if not silent:
                parent = stack[-1][1]
                found = attributes(given)
                words = (found.get(k, "") for k in ("class", "id", "role", "itemprop"))
                tokens = tuple(p.lower() for w in words for p in _PIECES.findall(w))
                hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                nodes.append(Node(name, parent, nodes[parent].depth + 1, tokens, hidden, "data-gold" in found or nodes[parent].gold and "data-dross" not in found))
                nodes[parent].content.append(len(nodes) - 1)
                opened(name, len(nodes) - 1)
            else:
                opened(name, stack[-1][1])
            continue
        if given.rstrip().endswith("/"):
            continue
        opened(name, stack[-1][1])
        silent += name in SILENT
        anchor += name == "a"
    text(len(source))
    return nodes


def own_blocks(node: Node) -> list[str | int]:
    """The node's texts, cut where a child block stands, and its children, in order."""
    out: list[str | int] = []
    held: list[str] = []
    for c in [*node.content, None]:
        if isinstance(c, str):
            held.append(c)
            continue
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(text)
            held = []
        if c is not None:
            out.append(c)
    return out


TAGS = (("article", "main"), ("nav", "footer", "header", "aside", "address"), ("div", "section", "center", "details"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "tr", "td", "th", "thead"), ("figure", "figcaption", "caption"), ("html", "body"))
HASHED = 24
WIDTH = 20 + len(TAGS) + HASHED


def features(nodes: list[Node], blocks: list[list[str | int]]) -> np.ndarray:
    n = len(nodes)
    own = np.array([sum(len(b) for b in x if isinstance(b, str)) for x in blocks], np.float64)
    marks = np.array([sum(b.count(".") + b.count(",") for b in x if isinstance(b, str)) for x in blocks], np.float64)
    linked = np.minimum(np.array([x.links for x in nodes], np.float64), own)
    parent = np.array([x.parent for x in nodes])
    children = [[c for c in x if isinstance(c, int)] for x in blocks]
    whole, link, mark, below, inputs, phrases = own.copy(), linked.copy(), marks.copy(), np.zeros(n), np.array([x.inputs for x in nodes], np.float64), np.array([float(x.tag in PHRASE) for x in nodes])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (whole, link, mark, inputs, phrases):
            a[p] += a[i]
        below[p] += below[i] + 1
    good, bad = np.zeros(n), np.zeros(n)
    up_good, up_bad = np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    out = np.zeros((n, WIDTH))
    total = max(whole[0], 1.0)
    seen = 0.0
    for i, x in enumerate(nodes):
        good[i] = sum(t in GOOD for t in x.tokens)
        bad[i] = sum(t in BAD for t in x.tokens) + (x.tag in TAGS[1])
        if i:
            p = parent[i]
            up_good[i] = up_good[p] + good[p] + (nodes[p].tag in TAGS[0])
            up_bad[i] = up_bad[p] + bad[p]
        before[i] = seen
        seen += own[i]
        for k, tags in enumerate(TAGS):
            out[i, 20 + k] = x.tag in tags
        for t in x.tokens:
            out[i, 20 + len(TAGS) + zlib.crc32(t.encode()) % HASHED] += 1
    place, many, kin = np.zeros(n), np.ones(n), np.zeros(n)
    kin[0] = whole[0]
    for own_children in children:
        if own_children:
            place[own_children] = np.arange(len(own_children))
            many[own_children] = len(own_children)
            kin[own_children] = whole[own_children].mean()
    for i, x in enumerate(nodes):
        out[i, :20] = (
            x.depth, math.log1p(whole[i]), math.log1p(own[i]), link[i] / max(whole[i], 1), math.log1p(below[i]),
            phrases[i] / (below[i] + 1), math.log1p(whole[i] / (below[i] + 1)), place[i] / many[i], math.log1p(many[i]),
            math.log1p(kin[i]), whole[i] / max(whole[parent[i]] if i else total, 1), whole[i] / total,
            mark[i] / max(whole[i], 1) * 20, good[i], bad[i], min(up_good[i], 3), min(up_bad[i], 3), before[i] / total,
            math.log1p(inputs[i]), x.hidden,
        )
    return out


# ---- boosted trees


@dataclass
class Boosted:
    """Trees of one depth, as arrays: a feature and a cut for each inner node, a value for each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.value.shape[1].bit_length() - 1
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (v.shape[0] - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        share = y.mean()
        start = math.log(share / (1 - share))
        total = np.full(len(y), start)
        features_, cuts_, values = [], [], []
        wide = bins + 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                slot = at - first
                best = np.full(count, 1e-6)
                split = [(0, np.inf, wide)] * count
                for f, own in enumerate(cuts):
                    if not len(own):
                        continue
                    key = slot * wide + binned[:, f]
                    gs = np.bincount(key, g, count * wide).reshape(count, wide).cumsum(1)
                    hs = np.bincount(key, h, count * wide).reshape(count, wide).cumsum(1)
                    gl, hl = gs[:, :-1], hs[:, :-1]
                    gain = gl**2 / (hl + ridge) + (gs[:, -1:] - gl) ** 2 / (hs[:, -1:] - hl + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                    gain = gain[:, : len(own)]
                    top = gain.argmax(1)
                    for s in np.flatnonzero(gain[np.arange(count), top] > best):
                        best[s] = gain[s, top[s]]
                        split[s] = (f, own[top[s]], top[s])
                for s, (f, c, _) in enumerate(split):
                    feature[first + s], cut[first + s] = f, c
                chosen, bound = np.array([s[0] for s in split]), np.array([s[2] for s in split])
                at = 2 * at + 1 + (binned[np.arange(len(y)), chosen[slot]] > bound[slot])
            leaf = at - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            total += value[leaf]
            features_.append(feature)
            cuts_.append(cut)
            values.append(value)
        return cls(np.array(features_), np.array(cuts_), np.array(values), start)


# ---- training pages


class Maker:
    """Pages with known article parts (marked ``data-gold``), in the manners that pages are built in."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        syllables = ("ba", "con", "de", "er", "fi", "gra", "in", "ko", "lu", "men", "nor", "o", "per", "qui", "ra", "st", "tion", "u", "ver", "za")
        out = ["".join(r.choices(syllables, k=r.randint(1, 3))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
        return " ".join(out)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).rstrip(",").capitalize() + "." for _ in range(self.r.randint(low, high)))

    def links(self, low: int = 2, high: int = 9) -> str:
        r = self.r
        made = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in made) + "</ul>"
        return r.choice((" ", " | ", " &middot; ")).join(made)

    def named(self, tag: str, names: tuple[str, ...], inner: str, bare: float = 0.0) -> str:
        """A semantic element, or a div that only its class or id tells apart."""
        r = self.r
        name = r.choice(names)
        given = f' {r.choice(("class", "id"))}="{name}"'
        if r.random() < bare:
            return f"<{tag}>{inner}</{tag}>"
        if r.random() < 0.5:
            return f"<{tag}{given if r.random() < 0.5 else ''}>{inner}</{tag}>"
        return f"<div{given}>{inner}</div>"

    def dross(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.named("nav", ("nav", "main-menu", "navbar", "site-navigation"), self.links())
        if kind == 1:
            return self.named("header", ("header", "site-header", "masthead", "top"), f"<h2>{self.words(1, 4)}</h2>" * r.randint(0, 1) + f"<p>{self.words(2, 8)}</p>" + self.links() * r.randint(0, 1))
        if kind == 2:
            return self.named("aside", ("sidebar", "side", "widget", "related", "right-rail"), f"<h3>{self.words(1, 3)}</h3>" + (self.links() if r.random() < 0.6 else f"<p>{self.sentences(1, 3)}</p>"))
        if kind == 3:
            inner = self.sentences(1, 2)
            return f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot banner"))}">{inner if r.random() < 0.6 else f"<p>{inner}</p>"}</div>'
        if kind == 4:
            return f'<div {r.choice(("class", "id"))}="{r.choice(("cookie-notice", "consent", "notice", "alert", "popup", "gdpr-banner"))}"><p>{self.sentences(1, 3)}</p></div>'
        if kind == 5:
            inner = "".join(f'<{r.choice(("div", "li", "article"))} class="{r.choice(("comment", "reply", "comment-body"))}"><p>{self.words(1, 2)}</p><p>{self.sentences(1, 4)}</p></div>' for _ in range(r.randint(1, 6)))
            return self.named("section", ("comments", "comment-list", "discussion", "responses", "user-comments"), f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + inner, 0.0)
        if kind == 6:
            return f'<div class="{r.choice(("share", "social-links", "tags", "breadcrumbs", "pagination"))}">{self.links(2, 6)}</div>'
        if kind == 7:
            return f'<div class="{r.choice(("newsletter", "subscribe", "signup", "search"))}"><p>{self.sentences(1, 2)}</p><form><input><button>x</button></form></div>'
        return self.named("footer", ("footer", "site-footer", "copyright", "legal", "colophon footer"), f"&copy; {self.sentences(1, 3)}" if r.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p>" + self.links())

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.75:
                parts.append(f"<p>{'<b>' * (r.random() < 0.1)}{self.sentences(1, 7)}" + "</p>" * (r.random() < 0.85))
            elif kind < 0.81:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                parts.append(f"<div><p>{self.sentences(1, 4)}</p><p>{self.sentences(1, 4)}</p></div>")
            else:
                parts.append("<table>" + f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" * r.randint(1, 4) + "</table>")
            if r.random() < 0.06:
                parts.append(self.dross().replace(">", " data-dross>", 1))
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.45:
            return f"<article data-gold>{inner}</article>"
        if kind < 0.6:
            return f"<main data-gold>{inner}</main>"
        if kind < 0.85:
            return f'<div class="{r.choice(("content", "post-content", "entry", "article-body", "story", "main-text", "page-content"))}" data-gold>{inner}</div>'
        return f"<{r.choice(('div', 'section'))} data-gold>{inner}</div>"

    def page(self) -> str:
        r = self.r
        before = "".join(self.dross() for _ in range(r.randint(0, 4)))
        after = "".join(self.dross() for _ in range(r.randint(0, 4)))
        middle = self.article() if r.random() < 0.96 else ""
        if r.random() < 0.4:
            middle = f'<div{r.choice(("", " class=wrapper", " id=page"))}>{self.dross() * r.randint(0, 1)}{middle}{self.dross() * r.randint(0, 1)}</div>'
        return f"<html><head><title>t</title></head><body>{before}{middle}{after}</body></html>"


def holds_gold(nodes: list[Node], blocks: list[list[str | int]]) -> np.ndarray:
    out = np.array([n.gold and any(isinstance(b, str) for b in x) for n, x in zip(nodes, blocks, strict=True)], np.float64)
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] = max(out[nodes[i].parent], out[i])
    return out


def train(pages: int = 900, seed: int = 7) -> Boosted:
    maker = Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(maker.page())
        blocks = [own_blocks(n) for n in nodes]
        xs.append(features(nodes, blocks))
        ys.append(holds_gold(nodes, blocks))
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys))


# ---- decoding


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels under which a dropped node drops all below it."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        out[i] = keep[i] > drop[i] and (x.parent < 0 or out[x.parent])
    return out


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(s or "") for s in sources]
    blocks = [[own_blocks(n) for n in t] for t in trees]
    odds = model.log_odds(np.concatenate([features(t, b) for t, b in zip(trees, blocks, strict=True)]))
    out, at = [], 0
    for tree, block in zip(trees, blocks, strict=True):
        kept = decode(tree, odds[at : at + len(tree)].copy())
        at += len(tree)
        texts: list[str] = []
        todo: list[str | int] = [0]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                texts.append(x)
            elif kept[x]:
                todo.extend(reversed(block[x]))
        out.append("\n".join(texts))
    return out


def main_text(df: DataFrame, model: Boosted | None = None, batch_bytes: int = 2_000_000) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = model or train()
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", batch_bytes):
            texts = extract(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return df.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
