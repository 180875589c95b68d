"""Main text of web pages by boosted trees over DOM nodes.

A page is read into a tree of its block elements; inline elements count towards
the block they stand in. Every node gets features: its tag, tokens of its class,
id and role and of its ancestors', depth, text and link density of its subtree,
and how it compares with its siblings. Trees that were fitted on generated
pages give the probability that a node holds main text.

Decoding is hierarchical: a dropped node drops all below it, and among the
choices that obey this the likeliest is taken, bottom up. So no text is kept
under an ancestor that is dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import gbt
from quern.llm.common import small_batches
from quern.llm.html_pages import pages

#: Pages the trees are fitted on.
TRAIN_PAGES = 600
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role|data-drop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_GONE = {"head", "script", "style", "noscript", "template", "svg", "iframe", "select", "button", "textarea", "object", "canvas", "audio", "video", "title"}
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"}
#: Tags that may stand in a head; any other ends it.
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "script", "style", "template", "noframes"}
#: A slash that belongs to an attribute's unquoted value.
_SLASH = re.compile(r"""=\s*[^\s"'>]+/>\Z""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "acronym", "output", "ruby", "rt", "rp"}
_TAGS = ["nav", "header", "footer", "aside", "article", "main", "section", "div", "p", "h", "li", "ul", "table", "form", "quote", "other"]
_SAME = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote"}
#: Start tags that end an open element of these tags in the same block.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tr", "td", "th", "thead", "tbody", "p"}, "option": {"option"}}
_BARRIER = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "aside", "nav", "body", "html", "form", "blockquote", "header", "footer"}
#: Tokens of class, id and role that speak for one kind of element.
_HINTS = [
    {"nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "navigation", "topnav", "pagination", "pager", "tabs"},
    {"header", "masthead", "topbar", "logo", "banner", "top"},
    {"footer", "copyright", "colophon", "legal", "bottom", "contentinfo"},
    {"sidebar", "side", "aside", "widget", "related", "recommended", "popular", "rail", "complementary", "more", "teaser"},
    {"ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "adslot"},
    {"cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "overlay", "dialog", "subscribe", "message", "privacy"},
    {"comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "feedback", "reader"},
    {"share", "social", "sharing", "tags", "toolbar", "follow", "buttons"},
    {"form", "login", "search", "signup", "contact", "register", "subscribe"},
    {"article", "content", "post", "entry", "story", "body", "text", "main", "page", "hentry"},
]


class Node:
    __slots__ = ("tag", "up", "depth", "hints", "drop", "chars", "link", "parts", "tags", "controls", "marks", "rights", "blocks")

    def __init__(self, tag: str, up: int, depth: int, hints: int, drop: bool):
        self.tag, self.up, self.depth, self.hints, self.drop = tag, up, depth, hints, drop
        self.chars = self.link = self.tags = self.controls = self.marks = self.rights = 0
        self.parts: list[str] = []
        self.blocks: list[tuple[int, str]] = []


@lru_cache(4096)
def _hints(attributes: str) -> tuple[int, bool]:
    found, drop = 0, False
    for name, value in _ATTR.findall(attributes):
        if name == "data-drop":
            drop = True
        else:
            for token in _TOKEN.findall(value.lower()):
                for k, some in enumerate(_HINTS):
                    if token in some:
                        found |= 1 << k
    return found, drop


def _head_end(page: str, pos: int) -> int:
    """Where a head whose start tag ends at pos is over: after its end tag, or before a tag that cannot stand in it."""
    while m := _TAG.search(page, pos):
        name, ends = (m[2] or m[5] or "").lower(), m[1] or m[4]
        if ends and name == "head":
            return m.end()
        if name and (name in ("body", "html", "br") if ends else name not in _HEAD):
            return m.start()
        pos = m.end()
        if name in _RAW and not ends:
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, pos)
            pos = close.end() if close else len(page) if name in ("script", "style") else pos
    return len(page)


def parse(page: str) -> list[Node]:
    """Block nodes in page order, the root first; each text block is with the node that holds it.

    Of an element that holds no text to read, but lacks its end tag, only the
    tag is skipped; a script or style without one runs to the end of the page.
    """
    nodes, stack = [Node("html", -1, 0, 0, False)], [0]  # stack: node numbers, or inline tags as strings
    order = pos = gone = links = 0
    current = nodes[0]
    unclosed: set[str] = set()  # names without an end tag in the rest of the page

    def flush() -> None:
        nonlocal order
        if current.parts:
            text = " ".join(html.unescape("".join(current.parts)).split())
            current.parts.clear()
            if text:
                current.blocks.append((order, text))
                current.chars += len(text)
                current.rights += text.count("©")
                current.marks += sum(map(text.count, ",.;!?"))
                order += 1

    def text(chunk: str) -> None:
        if chunk and not gone:
            current.parts.append(chunk)
            if links:
                current.link += len(chunk)

    def pop_to(k: int) -> None:
        nonlocal current, links
        while len(stack) > k:
            top = stack.pop()
            if isinstance(top, str):
                links -= top == "a"
            else:
                flush()
                current = nodes[next(x for x in reversed(stack) if not isinstance(x, str))]

    def past(name: str, at: int) -> int:
        """Where the element whose start tag ends at `at` is over; `at` itself if its end tag is missing."""
        if name in unclosed:
            return at
        close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
        if not close:
            unclosed.add(name)
            return at
        # Buttons and lists of options do not nest: another start tag comes first, so this one is not closed.
        nested = name in ("button", "select") and re.compile(rf"<{name}[\s/>]", re.IGNORECASE).search(page, at, close.start())
        return at if nested else close.end()

    end = len(page)
    while pos < end:
        m = _TAG.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name or not m[0].endswith(">"):
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if name in _GONE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                top = stack[k]
                if (top if isinstance(top, str) else nodes[top].tag) == name:
                    pop_to(k)
                    break
                if not isinstance(top, str) and (name in _INLINE or name == "p" and nodes[top].tag in _BARRIER):
                    break
            continue
        current.tags += 1
        if name == "svg" and m[0].endswith("/>") and not _SLASH.search(m[0]):
            continue
        if name in _RAW:
            pos = past(name, pos)
            if name in unclosed and name in ("script", "style"):
                pos = end
            continue
        if name in _GONE:
            current.controls += 1
            pos = _head_end(page, pos) if name == "head" else past(name, pos)
            continue
        if name in _VOID:
            current.controls += name == "input"
            if name == "hr":  # parts two blocks
                flush()
            elif name in ("br", "img"):
                text(" ")
            continue
        attributes = m[3] or m[6] or ""
        if name in _INLINE:
            stack.append(name)
            links += name == "a"
            continue
        if name in ("html", "body"):
            continue
        closes = _CLOSES.get(name, {"p"})
        for k in range(len(stack) - 1, 0, -1):
            top = stack[k]
            if isinstance(top, str):
                continue
            if nodes[top].tag in closes:
                pop_to(k)
                if name in ("p", "div") or nodes[top].tag == name:
                    break
            elif nodes[top].tag in _BARRIER:
                break
        flush()
        hints, drop = _hints(attributes)
        up = next(x for x in reversed(stack) if not isinstance(x, str))
        nodes.append(Node(name, up, nodes[up].depth + 1, hints, drop))
        stack.append(len(nodes) - 1)
        current = nodes[-1]
    pop_to(1)
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    n = len(nodes)
    up = [x.up for x in nodes]
    own = np.array([(x.chars, min(x.link, x.chars + 50), x.tags, x.controls, x.marks, len(x.blocks), x.tag == "p", x.tag == "li", x.rights) for x in nodes], float)
    total, kids = own.copy(), np.zeros(n)
    for k in range(n - 1, 0, -1):
        total[up[k]] += total[k]
        kids[up[k]] += 1
    above = [0] * n
    tags_above = [0] * n
    for k in range(1, n):
        above[k] = above[up[k]] | nodes[up[k]].hints
        kind = nodes[up[k]].tag
        tags_above[k] = tags_above[up[k]] | (1 << _TAGS.index(kind) if kind in _TAGS[:8] else 0)
    parent = np.maximum(np.array(up), 0)
    chars, links = total[:, 0], total[:, 1]
    before = np.zeros(n)
    before[1:] = np.cumsum(own[:, 0])[:-1]
    whole = max(chars[0], 1)
    tag = np.array([_TAGS.index(_SAME.get(x.tag, x.tag if x.tag in _TAGS else "other")) for x in nodes])
    hints, above_, tags_above_ = np.array([x.hints for x in nodes]), np.array(above), np.array(tags_above)
    bits = np.arange(len(_HINTS))
    columns = [
        np.array([x.depth for x in nodes]), np.log1p(chars), links / np.maximum(chars, 1), chars / (total[:, 2] + 1), np.log1p(total[:, 2]), total[:, 3],
        total[:, 4] / np.maximum(chars, 1), np.log1p(total[:, 5]), np.log1p(total[:, 6]), np.log1p(total[:, 7]), chars / whole, before / whole, kids,
        kids[parent], chars / np.maximum(chars[parent], 1), chars * np.maximum(kids[parent], 1) / np.maximum(chars[parent], 1), own[:, 0] / np.maximum(chars, 1),
        (links / np.maximum(chars, 1))[parent], np.log1p(own[:, 0]), total[:, 8], (np.arange(n) - parent) / n,
    ]
    rows = np.stack(columns, 1).astype(float)
    shown = [(tag[:, None] == np.arange(len(_TAGS))), hints[:, None] >> bits & 1, above_[:, None] >> bits & 1, tags_above_[:, None] >> np.arange(8) & 1, (tag[parent][:, None] == np.arange(len(_TAGS)))]
    return np.concatenate([rows, *(s.astype(float) for s in shown)], 1)


@lru_cache(1)
def model(n: int = TRAIN_PAGES, seed: int = 5) -> gbt.Model:
    """Trees fitted on n generated pages; the same for the same arguments."""
    x, y = [], []
    for page in pages(n, seed):
        nodes = parse(page)
        gone = [False] * len(nodes)
        main = [False] * len(nodes)
        for k, node in enumerate(nodes):
            gone[k] = node.drop or (k > 0 and gone[node.up])
        for k in range(len(nodes) - 1, -1, -1):
            main[k] = main[k] or (bool(nodes[k].blocks) and not gone[k])
            if k and main[k]:
                main[nodes[k].up] = True
        has = features(nodes)
        use = np.flatnonzero(has[:, 1] > 0)
        x.append(has[use])
        y.append(np.array(main)[use])
    return gbt.fit(np.concatenate(x), np.concatenate(y), trees=60, depth=5, rate=0.25, least=5)


def decode(nodes: list[Node], score: np.ndarray) -> list[str]:
    """The kept blocks in page order; score is each node's log odds of holding main text."""
    n = len(nodes)
    score = np.clip(score, -12, 12)
    keep, drop = -np.log1p(np.exp(-score)), -np.log1p(np.exp(score))
    keep, drop = keep.tolist(), drop.tolist()
    for k in range(n - 1, 0, -1):
        keep[nodes[k].up] += max(keep[k], drop[k])
        drop[nodes[k].up] += drop[k]
    kept, out = [True] * n, []
    for k in range(n):
        if k:
            kept[k] = kept[nodes[k].up] and keep[k] >= drop[k]
        if kept[k]:
            out += nodes[k].blocks
    return [text for _, text in sorted(out)]


def texts_of(html_texts: list[str | None], trees: gbt.Model) -> list[str]:
    """The main text of each page, blocks joined by an empty line; empty if none."""
    parsed = [parse(p or "") for p in html_texts]
    if not parsed:
        return []
    rows = [features(nodes) for nodes in parsed]
    score = trees.score(np.concatenate(rows))
    out, at = [], 0
    for nodes in parsed:
        out.append("\n\n".join(decode(nodes, score[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", trees: gbt.Model | None = None) -> DataFrame:
    """Every row's key, url, text and n_chars (code points). A null page is empty and has an empty text.

    No shuffle. Null or repeated keys keep their rows; other columns of df are
    ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    trees = trees or model()
    rows = df.select(df[key].alias(key), df[url].alias(url), df[page].alias("_html"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                out = texts_of(part.column(2).to_pylist(), trees)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [key, url, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
