"""Operator 6: main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with the elements that hold them. A linear classifier gives each
block a score: the kinds of its elements and the words in their class, id and role speak for themselves
(fixed values), and length, links and the end of the text have weights that ``fit`` learns by logistic
regression from the blocks whose elements leave no doubt (inside of article or main, of nav, footer and
the like), pulled towards defaults; at most ``train_rows`` pages, those with the least hashes, are read
for that. A positive score is the capacity from the source (content), a negative one that to the sink
(boilerplate). Neighbouring blocks, and neighbours among the blocks whose elements have one parent, are
joined by smoothness edges that weigh more the nearer they stand in the tree. The maximum flow separates
the two sides; blocks on the source side are the text: a short heading between paragraphs goes with them.
Scripts, styles, hidden elements, embedded objects and comments have no text; an object or video that is
never closed hides nothing. ``br`` is white space, not the end of a block.

Null and empty html give an empty text; a page with no content side gives an empty text. One row out
for each row in; null ids and urls are kept; extra columns are not carried. Nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)[^>]*>|<[!?/][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+|[0-9]+")
#: Elements by their role in a page.
RAW = frozenset("script style iframe textarea noembed noframes xmp".split())
EMBEDDED = frozenset("noscript template svg canvas object video audio math select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
} | {t: ("p",) for t in BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "html", "head", "body", "title"}}
WALLS = frozenset("html body table ul ol dl div section article main aside nav header footer form".split()) | EMBEDDED
ZONES = {"head": -9.0, "title": -9.0, "nav": -7.0, "footer": -7.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0, "search": -6.0, "button": -6.0, "header": -4.0, "article": 5.0, "main": 4.0}
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " comment comments disqus reply replies widget toolbar pagination pager copyright legal disclaimer search skip".split()
)
GOOD_WORDS = frozenset("article content main post story entry body text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An open element: its name, what it and its ancestors add to a block's score, its number and that of the block around it."""

    __slots__ = ("tag", "score", "hidden", "link", "number", "good", "up")

    def __init__(self, tag: str, attrs: str, parent: Node | None, number: int):
        self.tag, self.number = tag, number
        self.up = 0 if parent is None else parent.number if parent.tag in BLOCK else parent.up
        self.hidden, self.link = (parent.hidden, parent.link) if parent else (False, False)
        self.score, self.good = (parent.score, parent.good) if parent else (0.0, False)
        self.hidden = self.hidden or tag in EMBEDDED
        own = ZONES.get(tag, 0.0)
        if tag == "header" and self.good:
            own = -1.0  # an article's own header may hold its title
        self.link = self.link or tag == "a"
        if attrs and not attrs.isspace():
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                    self.hidden = True
                elif name in ("class", "id"):
                    words = set(WORD.findall(value))
                    if words & BAD_WORDS:
                        own = min(own, 0.0) - 6.0
                    elif words & GOOD_WORDS:
                        own += 2.0
                elif name == "role" and value in BAD_ROLES:
                    own = min(own, 0.0) - 6.0
                elif name == "role" and value in ("main", "article"):
                    own += 4.0
        if own > 0:
            self.good = True
            self.score = max(self.score, min(own, 5.0)) if self.score >= 0 else self.score
        elif own < 0:
            self.score = min(self.score, 0.0) + own


def closed(page: str, name: str) -> set[int]:
    """Where the elements of one name begin that have an end of their own."""
    found, open_ = set(), []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            found.add(open_.pop())
    return found


def blocks_of(page: str) -> list[tuple[str, float, int, int, int]]:
    """(text, score of the elements, length of link text, number of the element around the block's own, depth) of each block in page order."""
    ends: dict[str, set[int]] = {}
    stack = [Node("", "", None, 0)]
    out, parts, links, at, count, owner = [], [], 0, 0, 0, stack[0]

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, owner.score, links, owner.up, depth))
        parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links, owner, depth
        top = stack[-1]
        if top.hidden or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts or not text.isspace() and owner.number != top.number:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in BLOCK or not k:
                    owner, depth = stack[k], k
                    break
            if top.score < owner.score:
                owner = top
        parts.append(text)
        if top.link:
            links += len(text.strip())

    depth, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS and name not in WALLS:
                    break
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            closes = CLOSES.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS:
                    break
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not (m[3] or "").endswith("/"):
                at = close.end() if close else end
            continue
        if name in EMBEDDED:
            if name not in ends:
                ends[name] = closed(page, name)
            if m.start() not in ends[name]:
                continue
        if name not in VOID and not (m[3] or "").endswith("/"):
            count += 1
            stack.append(Node(name, m[3] or "", stack[-1], count))
    flush()
    return out


#: What speaks for content if nothing is learned: a constant, length, share of links, the end of a sentence.
WEIGHTS = (-0.8, 1.0, -3.0, 0.5)


def measures(text: str, links: int) -> tuple[float, float, float, float]:
    n = len(text)
    return 1.0, min(n, 200) / 100, min(1.0, links / max(n, 1)), float(text[-1:] in ".!?:;")


def score(text: str, zone: float, links: int, weights: tuple[float, ...] = WEIGHTS) -> float:
    """The elements' score, and within the bounds of the default weights what the text itself says."""
    own = sum(w * x for w, x in zip(weights, measures(text, links)))
    return zone + max(-3.8, min(1.7, own))


def fit(pages: DataFrame, html_col: str = "html", train_rows: int = 500, pull: float = 0.5, sure: float = 4.0) -> tuple[float, ...]:
    """Weights of a block's measures, from the blocks of at most ``train_rows`` pages whose elements score ``sure`` or more, either way."""
    rows = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("h", F.xxhash64("html"))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(train_rows).collect()]
    if not least:
        return WEIGHTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, int] = {}
            for page in batch.column(0):
                for text, zone, links, _, _ in blocks_of(page.as_py()):
                    if abs(zone) >= sure:
                        key = (*(round(x, 2) for x in measures(text, links)), zone > 0)
                        sums[key] = sums.get(key, 0) + 1
            columns = list(zip(*((*k, n) for k, n in sums.items()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.float64()] * 4 + [pa.bool_(), pa.int64()])], names=["a", "b", "c", "d", "good", "n"])

    sample = rows.filter(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("html").mapInArrow(run, "a double, b double, c double, d double, good boolean, n long")
    found = sorted((r.a, r.b, r.c, r.d, r.good, r.n) for r in sample.groupBy("a", "b", "c", "d", "good").agg(F.sum("n").alias("n")).collect())
    if len({f[4] for f in found}) < 2:
        return WEIGHTS
    x, good, n = np.array([f[:4] for f in found]), np.array([f[4] for f in found], float), np.array([f[5] for f in found], float)
    for side in (0.0, 1.0):  # either class weighs the same
        n[good == side] /= n[good == side].sum()
    start = np.array(WEIGHTS)
    w = start.copy()
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ w))
        w += 0.3 * (x.T @ (n * (good - p)) - pull * (w - start))
        w = start * np.clip(w / start, [0.5, 1, 1, 1], [1, 2, 2, 2])  # weak labels may sharpen a measure, not turn it round
    return tuple(float(v) for v in w)


def max_flow_side(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. Edges are undirected."""
    n = len(source)
    s, t = n, n + 1
    to, cap, near = [], [], [[] for _ in range(n + 2)]

    def link(a: int, b: int, c: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        cap.append(c)
        near[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in range(n):
        if source[v] > 0:
            link(s, v, source[v], 0.0)
        if sink[v] > 0:
            link(v, t, sink[v], 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in near[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, v = [], s
                continue
            while turn[v] < len(near[v]):
                e = near[v][turn[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(near[v]):
                path.append(near[v][turn[v]])
                v = to[path[-1]]
            elif v == s:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def edges_of(blocks: list[tuple[str, float, int, int, int]], adjacency: float, proximity: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and neighbours among those with one parent."""
    edges = []
    for k in range(1, len(blocks)):
        edges.append((k - 1, k, adjacency / (1 + abs(blocks[k - 1][4] - blocks[k][4]))))
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        if block[3] in last:
            edges.append((last[block[3]], k, proximity))
        last[block[3]] = k
    return edges


def extract(page: str | None, adjacency: float = 0.6, proximity: float = 0.6, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = [score(text, zone, links, weights) for text, zone, links, _, _ in blocks]
    keep = max_flow_side([max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], edges_of(blocks, adjacency, proximity))
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def main_text(pages: DataFrame, weights: tuple[float, ...] = WEIGHTS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), weights=weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
