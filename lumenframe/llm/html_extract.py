"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the hierarchy.

A page is read into a tree of block elements; inline elements (links, emphasis,
line breaks and the like) belong to the block they stand in. Where a block holds
both text and blocks, and in the body, each run of bare text between blocks is a
node of its own, judged like any other. Each node gets features: its tag and its
ancestors' tags, tokens of its class, id and role attributes, text and link density
of its subtree, depth, place among its siblings and how alike they are, sizes and
links of the siblings beside it, punctuation, copyright marks, and its place in the
page. Boosted trees give the chance that a node holds main text.

Decoding: a node can only be kept if its parent is. The best such choice of all
nodes is found bottom up: a subtree is either dropped whole, or its root is kept
and each child decides for itself; log chances add up. So no dropped ancestor
has kept descendants, and a lone confident guess inside a menu does not survive.
The body itself is always kept, as it has no text of its own.

The trees are trained here, on pages that ``template_pages`` writes in many
layouts (semantic tags, bare divisions with named classes, comments inside and
outside the article, notices, adverts, forms, side bars, bare text beside blocks,
pages without an article) with known answers; nothing is downloaded, and no page's own URL or id is an input.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one space. Scripts, styles, comments
and the head never count as text.

Defined cases: null and empty html give an empty text; unclosed and misnested
tags close as their parents do; a quote within an unquoted attribute value is
part of it; text outside any element is a node under the body; pages of any length
and depth are read whole, in time linear in their length; repeated rows are
treated one by one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import ship

ship(__name__)
ship(gbt.__name__)

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
SKIP = set("script style head title noscript template iframe svg math canvas object audio video map select option datalist textarea button xmp noembed noframes".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}

#: A quote opens a value only after ``=``; one that is never closed is an ordinary character.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|=|[^>=]++)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: The tag of a run of bare text.
RUN = "#text"
MARK = re.compile(r"©|&copy|&#169|&#xa9|\(c\)|copyright", re.I)
TAGS = f"article main section div p h1 h2 h3 ul li table td blockquote pre nav header footer aside form figure dl {RUN}".split()
TAG_PLACE = {t: i for i, t in enumerate(TAGS)}
GROUPS = {
    "main": "article content post entry main body story text prose page blog markdown maincontent articlebody",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager skip links",
    "head": "header masthead banner topbar logo brand hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside widget rail related recommended popular trending tags archive recent more",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted outbrain taboola dfp adsense",
    "note": "cookie cookies consent notice notification alert gdpr popup modal overlay toast message privacy warning",
    "form": "form login signin signup subscribe subscription newsletter search register contact",
    "talk": "comment comments reply replies disqus respond discussion thread reader readers feedback responses",
    "share": "share sharing social follow twitter facebook buttons toolbar tools print meta byline author date tags rating",
}
TOKEN_GROUP = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
N_GROUPS = len(GROUPS)


class Node:
    __slots__ = ("tag", "parent", "items", "groups", "links", "tags")

    def __init__(self, tag, parent, groups=()):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.items: list = []  # texts and nodes, in order
        self.links = self.tags = 0


def _groups(attributes: str) -> tuple[int, ...]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        for t in TOKEN.findall(m[2] or m[3] or m[4] or ""):
            g = TOKEN_GROUP.get(t.lower())
            if g is not None:
                found.add(g)
    return tuple(sorted(found))


def parse(html: str) -> Node:
    """The tree of block elements and runs of text, which are raw, still with character references. One pass, linear in the page."""
    root = Node("body", None)
    stack = [root]  # open block elements
    opened: dict[str, int] = {}  # how many of each tag are in the stack
    inline: dict[str, int] = {}  # open inline elements of the block
    at = 0
    lower = None

    def text(raw: str) -> None:
        if raw:
            items = stack[-1].items
            if not items or items[-1].tag != RUN:
                items.append(Node(RUN, stack[-1]))
            if inline.get("a") and not raw.isspace():
                items[-1].links += len(raw.strip())
            items[-1].items.append(raw)

    def mark() -> None:
        items = stack[-1].items
        (items[-1] if items and items[-1].tag == RUN else stack[-1]).tags += 1

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]
        inline.clear()

    def shut(tags, fence) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return cut(i)
            if stack[i].tag in fence:
                return

    size = len(html)
    while at < size:
        m = MARKUP.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if inline.get(tag):
                    inline[tag] -= 1
            elif opened.get(tag):
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW and not m[3].endswith("/"):
            lower = html.lower() if lower is None else lower
            if len(lower) != size:
                lower = re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            end = lower.find("</" + tag, at)
            at = size if end < 0 else end
            close = html.find(">", at)
            at = size if close < 0 else close + 1
            mark()
            continue
        if tag in ("html", "body"):
            continue
        if tag in INLINE:
            mark()
            if tag in VOID:
                text(" ")
            elif not m[3].endswith("/"):
                inline[tag] = inline.get(tag, 0) + 1
            continue
        if tag in CLOSES_P:
            shut({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "main", "aside", "table"})
        if tag in SAME:
            shut(SAME[tag], FENCE.get(tag, set()))
        node = Node(tag, stack[-1], _groups(m[3]) if m[3] else ())
        stack[-1].items.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def settle(node: Node, root: bool) -> None:
    """Drop blank runs and what never counts as text; a block of nothing but text holds it itself."""
    items = []
    for x in node.items:
        if x.tag == RUN and not unescape("".join(x.items)).strip():
            node.tags += x.tags
        elif x.tag not in SKIP:
            items.append(x)
    if items and not root and all(x.tag == RUN for x in items):
        node.links += sum(x.links for x in items)
        node.tags += sum(x.tags for x in items)
        items = [s for x in items for s in (" ", *x.items)]
    node.items = items


class Page:
    """Nodes in page order with the features of each."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.nodes: list[Node] = []
        up: list[int] = []
        todo = [(self.root, -1)]
        while todo:
            node, parent = todo.pop()
            if node.tag != RUN:
                settle(node, parent < 0)
            i = len(self.nodes)
            self.nodes.append(node)
            up.append(parent)
            todo.extend((x, i) for x in reversed(node.items) if isinstance(x, Node))
        self.up = np.array(up)
        self.features = self._features()

    def _features(self) -> np.ndarray:
        nodes, up = self.nodes, self.up
        n = len(nodes)
        own = np.zeros((n, 6))  # characters, words, links, tags, marks, nodes
        rights = np.zeros(n)
        for i, x in enumerate(nodes):
            t = "".join(s for s in x.items if isinstance(s, str))
            own[i] = len(t.strip()), t.count(" ") + bool(t.strip()), x.links, x.tags, t.count(".") + t.count(","), 1
            rights[i] = bool(MARK.search(t))
        below = own.copy()
        for i in range(n - 1, 0, -1):
            below[up[i]] += below[i]
        before = np.cumsum(own[:, 0]) - own[:, 0]
        total = max(1.0, below[0, 0])
        depth = np.zeros(n)
        tag = np.array([TAG_PLACE.get(x.tag, len(TAGS)) for x in nodes])
        above_tag = np.zeros((n, len(TAGS) + 1), bool)
        group = np.zeros((n, N_GROUPS), bool)
        above_group = np.zeros((n, N_GROUPS), bool)
        children: dict[int, list[int]] = {}
        for i in range(n):
            group[i, list(nodes[i].groups)] = True
            if i:
                p = up[i]
                depth[i] = depth[p] + 1
                above_tag[i] = above_tag[p]
                above_tag[i, tag[p]] = True
                above_group[i] = above_group[p] | group[p]
                children.setdefault(p, []).append(i)
        place, count, alike = np.zeros(n), np.ones(n), np.ones(n)
        beside = np.zeros((n, 6))  # of the siblings before and after: characters, share of links, whether there is one
        chars = np.maximum(1.0, below[:, 0])
        for own_children in children.values():
            each = Counter(nodes[c].tag for c in own_children)
            size = len(own_children)
            for j, c in enumerate(own_children):
                place[c], count[c], alike[c] = j / size, size, each[nodes[c].tag] / size
            c = np.array(own_children)
            size_of, linked = np.log1p(below[c, 0]), below[c, 2] / chars[c]
            beside[c[1:], 0], beside[c[1:], 1], beside[c[1:], 2] = size_of[:-1], linked[:-1], 1
            beside[c[:-1], 3], beside[c[:-1], 4], beside[c[:-1], 5] = size_of[1:], linked[1:], 1
        one = np.zeros((n, len(TAGS) + 1), bool)
        one[np.arange(n), tag] = True
        plain = (own[:, 0] * ~(group | above_group)[:, 1:].any(1)).max()  # the longest text that no name puts aside
        dense = np.stack(
            [
                np.log1p(below[:, 0]), np.log1p(own[:, 0]), below[:, 2] / chars, below[:, 5] / chars * 100, below[:, 3] / chars * 100, below[:, 4] / np.maximum(1, below[:, 1]), below[:, 0] / total,
                before / total, depth, place, np.log1p(count), alike, own[:, 0] / chars, np.log1p(below[:, 5]), below[up, 0] / total, below[up, 2] / np.maximum(1.0, below[up, 0]),
                rights, np.full(n, np.log1p(total)), np.full(n, np.log1p(n)), np.full(n, np.log1p(plain)),
            ],
            1,
        )
        keep = [TAGS.index(t) for t in ("article", "main", "nav", "header", "footer", "aside", "form", "table", "ul", "blockquote", "p")]
        return np.concatenate([dense, beside, one, above_tag[:, keep], group, above_group], 1).astype(np.float64)

    def decode(self, chance: np.ndarray) -> np.ndarray:
        """The kept nodes: the likeliest choice in which every kept node's parent is kept."""
        p = np.clip(chance, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        drop, keep = no.copy(), yes.copy()
        for i in range(len(p) - 1, 0, -1):
            drop[self.up[i]] += drop[i]
            keep[self.up[i]] += max(drop[i], keep[i])
        kept = np.zeros(len(p), bool)
        kept[0] = True
        for i in range(1, len(p)):
            kept[i] = kept[self.up[i]] and keep[i] >= drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        place = {id(x): i for i, x in enumerate(self.nodes)}
        blocks: list[str] = []
        run: list[str] = []

        def end():
            if run:
                words = " ".join(unescape("".join(run)).split())
                if words:
                    blocks.append(words)
                run.clear()

        todo: list = [self.root]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            else:
                i = place.get(id(x))
                end()
                if i is not None and kept[i]:
                    todo.append(None)
                    todo.extend(reversed(x.items))
        end()
        return " ".join(blocks)


def template_pages(count: int = 500, seed: int = 3) -> list[str]:
    """Written pages; main words start with ``m``, all others with ``x``."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[rng.integers(len(a))]
    serial = iter(range(1 << 40))
    LENGTHS, STOPS = ["", "", "ab", "cdefg", "hijklmnop"], ["", "", "", "", "", ",", ".", "."]

    def words(kind, lo, hi):
        n = rng.integers(lo, hi + 1)
        ends, stops = rng.integers(0, 5, n).tolist(), rng.integers(0, 8, n).tolist()
        return " ".join(f"{kind}{next(serial)}{LENGTHS[e]}{STOPS[s]}" for e, s in zip(ends, stops)) + pick(".", ".", "")

    def wrap(tag, inner, cls=""):
        name = pick("class", "class", "id") if cls else ""
        return f"<{tag}{f' {name}="{cls}"' if cls else ''}>{inner}</{tag}>"

    def links(lo, hi):
        return "".join(f"<li><a href='/p'>{words('x', 1, 3)}</a></li>" for _ in range(rng.integers(lo, hi + 1)))

    def menu():
        inner = pick(f"<ul>{links(2, 12)}</ul>", " | ".join(f"<a href='#'>{words('x', 1, 2)}</a>" for _ in range(rng.integers(2, 9))))
        return pick(wrap("nav", inner), wrap("nav", inner, pick("main-nav", "menu")), wrap("div", inner, pick("menu", "navbar", "nav-main", "navigation", "breadcrumbs", "top-menu")), wrap("ul", links(3, 9), pick("menu", "nav")))

    def head():
        inner = pick(f"<h1>{words('x', 1, 4)}</h1>", f"<a href='/'>{words('x', 1, 3)}</a>", f"<p>{words('x', 2, 12)}</p>", wrap("div", words("x", 1, 5), "logo")) + pick("", menu())
        return pick(wrap("header", inner), wrap("div", inner, pick("header", "site-header", "masthead", "topbar")))

    def foot():
        inner = pick(f"&copy; {words('x', 2, 20)}", f"<p>{words('x', 4, 40)}</p>", f"<p>&copy; {words('x', 2, 8)}</p><ul>{links(2, 8)}</ul>")
        return pick(wrap("footer", inner), wrap("footer", inner), wrap("div", inner, pick("footer", "site-footer", "bottom", "copyright")))

    def side():
        inner = pick(f"<h3>{words('x', 1, 4)}</h3><ul>{links(2, 9)}</ul>", f"<h2>{words('x', 1, 4)}</h2><p>{words('x', 5, 50)}</p>", f"<p>{words('x', 5, 60)}</p>")
        return pick(wrap("aside", inner), wrap("aside", inner, pick("sidebar", "related")), wrap("div", inner, pick("sidebar", "side", "widget", "related-posts", "right-rail", "recommended")))

    def advert():
        inner = pick(words("x", 3, 60), f"<p>{words('x', 3, 50)}</p>", f"<a href='/buy'>{words('x', 2, 15)}</a>")
        return "<!-- ad -->" * int(rng.integers(2)) + wrap(pick("div", "div", "aside", "section"), inner, pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "adsbox"))

    def notice():
        inner = pick(f"<p>{words('x', 4, 40)}</p><button>ok</button>", words("x", 4, 40), f"{words('x', 4, 30)} <a href='#'>{words('x', 1, 3)}</a>")
        return wrap(pick("div", "div", "section", "aside", "p"), inner, pick("cookie-notice", "notice", "cookies", "consent", "alert", "gdpr-banner", "popup", "notification", "modal"))

    def form():
        inner = f"<label>{words('x', 1, 5)}</label><input name='q'>" + pick("", f"<p>{words('x', 3, 20)}</p>", f"<select><option>{words('x', 1, 2)}</select>") + pick("<button>go</button>", f"<input type='submit' value='x'>")
        return pick(f"<form action='/s'>{inner}</form>", wrap("div", f"<p>{words('x', 3, 20)}</p><form>{inner}</form>", pick("newsletter", "subscribe", "search", "login", "signup")))

    def talk():
        one = lambda: pick(wrap("div", f"<p>{words('x', 3, 70)}</p>", pick("comment", "reply", "comment-body")), f"<li><p>{words('x', 3, 60)}</p></li>", f"<p>{words('x', 3, 60)}</p>", wrap("article", f"<p>{words('x', 3, 60)}</p>", "comment"))
        inner = pick("", f"<h2>{words('x', 1, 3)}</h2>", f"<h3>{words('x', 1, 4)}</h3>") + "".join(one() for _ in range(rng.integers(1, 7)))
        return wrap(pick("div", "section", "section", "ol", "aside"), inner, pick("comments", "comment-list", "reader-comments", "discussion", "replies", "disqus_thread", "responses"))

    def share():
        return wrap("div", "".join(f"<a href='#'>{words('x', 1, 1)}</a> " for _ in range(rng.integers(2, 5))), pick("share", "social", "share-buttons"))

    def story():
        out = [pick("", f"<h1>{words('m', 2, 14)}</h1>", f"<h1>{words('m', 2, 14)}</h1>", f"<header><h1>{words('m', 2, 12)}</h1></header>", f"<h2>{words('m', 2, 12)}</h2>")]
        for _ in range(pick(1, 1, 2, 3, 5, 8, 14, 25)):
            t = words("m", *pick((1, 6), (1, 6), (5, 40), (5, 40), (20, 90), (20, 90), (40, 160), (40, 160), (300, 1500)))
            if rng.random() < 0.03:
                t = pick("&copy; ", "© ", "Copyright ") + t
            if rng.random() < 0.25:
                t = t.replace(" ", " <b>", 1).replace(" ", "</b> ", 3).replace("</b> ", " ", 2) if t.count(" ") > 6 else f"<em>{t}</em>"
            if rng.random() < 0.25:
                t += f" <a href='/r'>{words('m', 1, 4)}</a> {words('m', 0, 12)}"
            out.append(
                pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<h2>{words('m', 1, 7)}</h2><p>{t}</p>", f"<blockquote>{t}</blockquote>", f"<blockquote><p>{t}</p></blockquote>",
                     f"<ul>{''.join(f'<li>{words("m", 1, 14)}</li>' for _ in range(rng.integers(2, 7)))}</ul>", f"<div>{t}</div>", f"<section><h3>{words('m', 1, 5)}</h3><p>{t}</p></section>",
                     f"<table><tr><th>{words('m', 1, 2)}</th><td>{words('m', 1, 6)}</td></tr><tr><td>{words('m', 1, 3)}</td><td>{words('m', 1, 3)}</td></tr></table>", f"<pre>{words('m', 3, 20)}</pre>", f"<figure><img src='a'><figcaption>{words('m', 2, 12)}</figcaption></figure>")
            )
            if rng.random() < 0.08:
                out.append(pick(advert, side, share, form, notice)())
        return "".join(out)

    def bare():
        """Main text that stands between blocks, not in one."""
        out = [pick("", "", f"<h1>{words('m', 2, 14)}</h1>", f"<h2>{words('m', 2, 12)}</h2>")]
        for _ in range(pick(1, 1, 2, 3, 5, 8, 14)):
            t = words("m", *pick((4, 12), (4, 12), (5, 40), (5, 40), (20, 90), (20, 90), (40, 160), (40, 160), (300, 1500)))
            if rng.random() < 0.3:
                t += f" <a href='/r'>{words('m', 1, 4)}</a> {words('m', 1, 12)}"
            out.append(pick(t, t, f"<b>{words('m', 1, 4)}</b> {t}"))
            out.append(pick("<br><br>", "<br/>", "<br><br>", f"<p>{words('m', 4, 60)}</p>", f"<p>{words('m', 4, 60)}</p><p>{words('m', 4, 60)}</p>", f"<h2>{words('m', 1, 7)}</h2>", f"<blockquote>{words('m', 3, 30)}</blockquote>", f"<ul><li>{words('m', 1, 12)}</li><li>{words('m', 1, 12)}</li></ul>"))
            if rng.random() < 0.1:
                out.append(pick(advert, side, share, notice)())
        return "".join(out)

    def stray():
        """Bare text that is not main: rights, trails of links, a few words left over."""
        return pick(f"&copy; {words('x', 2, 14)}", f"© {words('x', 2, 14)}", f"Copyright {words('x', 2, 10)}", f"{words('x', 1, 5)} All rights reserved.", words("x", 1, 5), " | ".join(f"<a href='#'>{words('x', 1, 2)}</a>" for _ in range(rng.integers(2, 6))), f"<a href='/'>{words('x', 1, 2)}</a> &gt; <a href='/'>{words('x', 1, 2)}</a> &gt; {words('x', 1, 4)}")

    pages = []
    for _ in range(count):
        kind = rng.integers(8)
        body = bare() if rng.random() < (0.6 if kind >= 6 else 0.2) else story()
        inside = body + (pick(talk, share, form, side)() if rng.random() < 0.25 else "")
        if kind <= 2:
            middle = wrap("article", inside, pick("", "", "post", "article", "story"))
        elif kind == 3:
            middle = wrap("div", inside, pick("content", "post-content", "article-body", "entry-content", "main-text", "story", "main"))
        elif kind == 4:
            middle = wrap("main", inside)
        elif kind >= 6:
            middle = inside
        else:
            middle = wrap("div", inside)
        if rng.random() < 0.3:
            middle = wrap(pick("main", "div", "section"), middle + (pick(talk, side, advert)() if rng.random() < 0.5 else ""), pick("", "", "content", "container", "wrapper"))
        top = "".join(f() for f, p in ((notice, 0.25), (head, 0.5), (menu, 0.6), (advert, 0.45), (form, 0.15)) if rng.random() < p)
        end = "".join(f() for f, p in ((share, 0.15), (side, 0.4), (talk, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.2), (foot, 0.75)) if rng.random() < p)
        shape = rng.random()
        if shape < 0.14:  # a page without an article
            middle = ""
        if rng.random() < 0.2:
            top += stray() if top and kind < 6 else ""
        if rng.random() < 0.25:
            end += stray() if kind < 6 or (end or not middle) else f"<hr>{stray()}"
        if not middle and rng.random() < 0.8:
            top, end = (top or notice()) + pick("", stray()), end + stray()
        if shape > 0.88:  # nothing but the article, or but its text
            plain = words("m", *pick((1, 8), (1, 8), (5, 60), (40, 200)))
            top, middle, end = "", pick(body, bare(), plain, plain), ""
        both = top + middle + end
        if rng.random() < 0.25:
            both = wrap("div", both, pick("", "page", "wrapper", "container", "site"))
        pages.append(f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{both}" + pick("</body></html>", "</body></html>", ""))
    return pages


@cache
def trained(count: int = 700, seed: int = 3) -> gbt.Trees:
    x, y = [], []
    for html in template_pages(count, seed):
        page = Page(html)
        main = np.zeros(len(page.nodes), bool)
        for i in range(len(page.nodes) - 1, -1, -1):
            own = "".join(s for s in page.nodes[i].items if isinstance(s, str)).split()
            main[i] |= any(w[0] == "m" for w in own)
            if i and main[i]:
                main[page.up[i]] = True
        x.append(page.features)
        y.append(main)
    return gbt.fit(np.concatenate(x), np.concatenate(y).astype(float), rounds=80)


def extract(html: str | None, trees: gbt.Trees) -> str:
    if not html:
        return ""
    return extract_all([html], trees)[0]


def extract_all(htmls: list[str | None], trees: gbt.Trees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    chance = np.split(trees.probability(np.concatenate([p.features for p in pages])), np.cumsum([len(p.nodes) for p in pages])[:-1])
    return [p.text(p.decode(c)) for p, c in zip(pages, chance)]


def _run(trees: gbt.Trees):
    def run(batches):
        for batch in batches:
            htmls, out = batch.column(batch.num_columns - 1).to_pylist(), []
            for i in range(0, len(htmls), 64):
                out += extract_all(htmls[i : i + 64], trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(_run(trained()), "page_id long, url string, text string, n_chars long")
