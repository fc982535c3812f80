"""Main text of web pages by minimum-cut labelling.

A page becomes a row of blocks (text between block-level tags) with the
containers they stand in.  A logistic classifier of a block's text (length,
links, punctuation) and the meaning of its containers give each block a cost for
either label: these are the capacities from the source and to the sink.  Blocks
that follow each other, and blocks of the same container, are joined by edges
whose capacity falls with their distance in the document tree.  The maximum flow
then splits the page into content and boilerplate at the least total cost.

Blocks that are joined and lean to the same side need no flow; only joined
blocks with different leanings go through it.

The classifier is fitted on the blocks of at most ``TRAIN_PAGES`` pages, chosen
by hash, with the containers' meaning as the label.  Null and empty pages give
empty text.  Scripts, styles and comments are never text; character references
are decoded; white space inside a block becomes one blank.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm.common import bounded_sample, longs, strings, texts_of, with_columns

# Element names of HTML by their role.
RAW = frozenset("script style title textarea xmp".split())
# Not part of the page's text, but no raw text either: an open one ends with its parent, and without any end tag it is no container.
EMBEDDED = frozenset("noscript template svg iframe object canvas audio video select noembed noframes".split())
INLINE = frozenset(
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mpadded mphantom semantics annotation a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr button img input picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption pre blockquote address summary figcaption legend option".split())
BOILERPLATE = frozenset("nav footer aside form head menu dialog fieldset button".split()) | EMBEDDED
CONTENT = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_OPEN = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|(!--)|[!?/])")
_QUOTE = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_ENDS: dict[str, re.Pattern[str]] = {}

OUT, IN = -1, 1
STRUCTURE_COST = 6.0
TEXT_COST = 1.0
NEXT_EDGE = 2.0
SIBLING_EDGE = 0.5
TRAIN_PAGES = 300


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    node: int  # its container; see Tree
    lean: int  # what the innermost telling container says
    heading: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _meaning(name: str, raw: str, inside_article: bool) -> int:
    """What an element says about its text: boilerplate, content, or nothing (0)."""
    attributes = _attributes(raw)
    if attributes:
        if attributes.get("role", "").lower() in BOILERPLATE_ROLES:
            return OUT
        if name not in ("body", "html"):
            words = {p.lower() for key in ("class", "id") for p in _NAME_PART.findall(attributes.get(key, ""))}
            if words & BOILERPLATE_WORDS and not (name in CONTENT and not words & {"comment", "comments", "reply"}):
                return OUT
        if attributes.get("role", "").lower() in ("main", "article"):
            return IN
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return OUT
    return IN if name in CONTENT else 0


@dataclass
class Tree:
    """The containers of a page; 0 is the root."""

    parent: list[int]
    depth: list[int]

    def distance(self, a: int, b: int) -> int:
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends a tag; one inside a quoted value does not.  A quote that never closes is no quote."""
    while True:
        mark = _QUOTE.search(page, at)
        if not mark:
            return len(page)
        if mark[0] == ">":
            return mark.end()
        close = page.find(mark[0], mark.end())
        at = close + 1 if close >= 0 else mark.end()


class Nest:
    """Open elements, with a quick answer for a closing tag that has no opening one."""

    def __init__(self) -> None:
        self.items: list[tuple] = []
        self.open: dict[str, int] = {}

    def push(self, *item) -> None:
        self.items.append(item)
        self.open[item[0]] = self.open.get(item[0], 0) + 1

    def find(self, name: str) -> int:
        if not self.open.get(name):
            return -1
        return next(k for k in range(len(self.items) - 1, -1, -1) if self.items[k][0] == name)

    def cut(self, start: int, stop: int) -> list[tuple]:
        gone = self.items[start:stop]
        del self.items[start:stop]
        for item in gone:
            self.open[item[0]] -= 1
        return gone


def _end_of(name: str) -> re.Pattern[str]:
    end = _ENDS.get(name)
    if end is None:
        end = _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)
    return end


def blocks_of(page: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page in order; text of raw elements and markup is left out."""
    found: list[Block] = []
    tree = Tree([0], [0])
    containers = Nest()  # name, node, lean that holds inside
    inline = Nest()  # name, meaning
    parts: list[str] = []
    linked = buttons = 0
    last_end: dict[str, int] = {}  # of embedded elements, where an end tag stands that was looked up
    leaf, leaf_lean = "", 0

    def lean() -> int:
        own = containers.items[-1][2] if containers.items else 0
        return min(own, leaf_lean) if leaf_lean < 0 else own or leaf_lean

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = containers.items[-1][1] if containers.items else 0
                found.append(Block(text, min(linked, len(text)), node, lean(), leaf[:1] == "h"))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not buttons:
                parts.append(text)
                linked += len(text) if inline.open.get("a") else 0

    at = 0
    while True:
        tag = _OPEN.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        if tag[3]:
            stop = page.find("-->", tag.end() - 2)
            at = stop + 3 if stop >= 0 else len(page)
            continue
        if not tag[2]:
            stop = page.find(">", tag.end())
            at = stop + 1 if stop >= 0 else len(page)
            continue
        at = tag_end(page, tag.end())
        name, closing, raw = tag[2].lower(), bool(tag[1]), page[tag.end() : at].removesuffix(">")
        if name in RAW and not closing:
            stop = _end_of(name).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name in EMBEDDED and not closing:
            if last_end.get(name, 0) < at:
                stop = _end_of(name).search(page, at)
                last_end[name] = stop.start() if stop else len(page)
            if last_end[name] == len(page) or raw.rstrip().endswith("/"):
                continue
        if name in INLINE:
            if name in VOID or raw.endswith("/"):
                continue
            if closing:
                k = inline.find(name)
                if k >= 0:
                    buttons -= sum(item[0] == "button" for item in inline.cut(k, k + 1))
            else:
                inline.push(name, 0)
                buttons += name == "button"
            continue
        flush()
        if name in VOID:
            continue
        inline.cut(0, len(inline.items))
        buttons = 0
        if name in LEAF:
            leaf, leaf_lean = ("", 0) if closing else (name, _meaning(name, raw, True) if raw else 0)
            continue
        leaf, leaf_lean = "", 0
        if closing:
            k = containers.find(name)
            if k >= 0:
                containers.cut(k, len(containers.items))
        else:
            _, node, outer = containers.items[-1] if containers.items else ("", 0, 0)
            own = _meaning(name, raw, outer == IN)
            # Boilerplate inside content is boilerplate; content inside boilerplate stays boilerplate.
            containers.push(name, len(tree.parent), min(own, outer) if own < 0 or outer < 0 else own or outer)
            tree.parent.append(node)
            tree.depth.append(tree.depth[node] + 1)
    flush()
    return found, tree


FEATURES = 6


def text_features(block: Block) -> tuple[float, ...]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    return (1.0, min(math.log1p(n), 7.0), block.linked / n, min(stops / words, 1.0), float(text[-1] in ".!?:;\"'"), float(block.heading))


def train(pages: list[str]) -> np.ndarray:
    """Weights of the text features, from blocks whose containers tell what they are."""
    rows, labels = [], []
    for page in pages:
        for block in blocks_of(page)[0]:
            if block.lean:
                rows.append(text_features(block))
                labels.append(float(block.lean == IN))
    x, y = np.array(rows).reshape(-1, FEATURES), np.array(labels)
    weights = np.zeros(FEATURES)
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, 0.5, -3.0, 1.0, 0.5, 0.0])  # nothing to learn from: long text with few links
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1.0 * np.eye(FEATURES)
        move = np.linalg.solve(h, x.T @ (p - y) + 1.0 * weights)
        weights -= move
        if np.abs(move).max() < 1e-6:
            break
    return weights


def leanings(blocks: list[Block], weights: list[float]) -> list[float]:
    """Cost of calling a block boilerplate less the cost of calling it content."""
    out = []
    for block in blocks:
        z = sum(w * f for w, f in zip(weights, text_features(block), strict=True))
        out.append(TEXT_COST * max(-3.0, min(3.0, z)) + STRUCTURE_COST * block.lean)
    return out


def edges_of(blocks: list[Block], tree: Tree) -> Iterator[tuple[int, int, float]]:
    """Smoothness: next blocks by their distance in the tree, and the next block of the same container."""
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if k:
            before = blocks[k - 1]
            if before.lean == block.lean or not (before.lean and block.lean):
                yield k - 1, k, NEXT_EDGE / (1 + tree.distance(before.node, block.node)) ** 2
        other = last.get(block.node)
        if other is not None and other < k - 1:
            yield other, k, SIBLING_EDGE
        last[block.node] = k


def minimum_cut(leaning: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the source side (content) of a minimum cut, by shortest augmenting paths in level graphs."""
    n = len(leaning)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, lean in enumerate(leaning):
        if lean > 0:
            join(source, k, lean, 0.0)
        elif lean < 0:
            join(k, sink, -lean, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], source
                continue
            while place[a] < len(head[a]):
                e = head[a][place[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(head[a]):
                path.append(head[a][place[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                place[a] += 1
            else:
                break


def labels_of(blocks: list[Block], tree: Tree, weights: list[float]) -> list[bool]:
    """Content or not for every block.  Joined blocks that lean alike are labelled at once."""
    leaning = leanings(blocks, weights)
    edges = list(edges_of(blocks, tree))
    group = list(range(len(blocks)))

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for a, b, _ in edges:
        group[top(b)] = top(a)
    members: dict[int, list[int]] = {}
    for k in range(len(blocks)):
        members.setdefault(top(k), []).append(k)
    labels = [x > 0 for x in leaning]
    joined: dict[int, list[tuple[int, int, float]]] = {}
    for a, b, weight in edges:
        joined.setdefault(top(a), []).append((a, b, weight))
    for root, own in members.items():
        if min(leaning[k] for k in own) < 0 < max(leaning[k] for k in own):
            place = {k: i for i, k in enumerate(own)}
            cut = minimum_cut([leaning[k] for k in own], [(place[a], place[b], w) for a, b, w in joined[root]])
            for k, side in zip(own, cut, strict=True):
                labels[k] = side
    return labels


def main_text(page: str, weights: list[float]) -> str:
    blocks, tree = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, labels_of(blocks, tree, weights), strict=True) if keep)


def fit(pages: DataFrame, bound: int = TRAIN_PAGES) -> list[float]:
    """The classifier from at most ``bound`` pages."""
    usable = pages.select("page_id", "html").where("html is not null")
    return train([r.html for r in bounded_sample(usable, "page_id", bound).collect()]).tolist()


def extract(pages: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for batch in batches:
            found = [main_text(page, weights) for page in texts_of(batch.column("html"))]
            yield {"text": strings(found), "n_chars": longs([len(t) for t in found])}

    return with_columns(pages, "text string, n_chars bigint", run)
