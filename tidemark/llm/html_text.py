"""HTML extraction by minimum-cut labelling of text blocks.

A page is cut into blocks, the runs of text between block-level tags. A logistic
classifier over features of a block (its length, links and punctuation, its place in the
page, the elements and names it stands under) gives the log odds of being main text; positive
odds are its capacity from the source (content), negative ones to the sink
(boilerplate). Blocks that follow each other are joined by smoothness edges, the stronger the
nearer they are in the DOM, and so are blocks of one container. The minimum cut, found by
blocking flows, separates content from boilerplate at the least total cost: a short
paragraph between long ones stays, and a long entry of a menu goes, whatever their own odds.

The classifier starts from the weights `PRIOR` and is fitted on the blocks of at most
`TRAIN_PAGES` pages, whose weak labels come from pages' own mark-up: blocks under ``article`` or
``main`` count as content, those under ``nav``, ``footer`` and the like as boilerplate. Half of the blocks
are shown without that mark-up, and half as if they were plain ``div``s, so that text and place must carry weight of their own, whatever
elements a site writes its paragraphs in. Mark-up of boilerplate outweighs the best text. Yet no
single feature decides: odds are bounded by `MOST_ODDS`, and edges can overturn any of them. A page whose blocks are all
called boilerplate, but for one that is long, without links and unmarked, is judged by a lower bar.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "head", "title", "textarea", "select", "button", "option"}
#: Raw elements that hold no markup: they end at their own end tag only.
OPAQUE = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"br", "img", "input", "meta", "link", "hr", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes, if it is open inside the nearest of its boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Names of elements and words of class, id and role attributes that speak for boilerplate or for content, by feature.
ELEMENTS = {"nav": "menu", "menu": "menu", "footer": "footer", "header": "header", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "form", "article": "article", "main": "article"}
NAMES = {
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion teaser",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toolbar pagination pager skip",
    "footer": "footer copyright legal disclaimer",
    "header": "masthead topbar",
    "aside": "sidebar aside related recommended recommendations widget share sharing social",
    "comment": "comment comments reply replies respond disqus discussion discussions",
    "notice": "cookie cookies consent notice notices notification alert popup modal overlay",
    "form": "newsletter subscribe subscription signup login",
    "content": "article content main post entry story body text",
}
CONTENT = frozenset({"article", "content"})
WORDS = {word: kind for kind, words in NAMES.items() for word in words.split()}
#: Features and the weights that fitting starts from. The first group is hidden from half of the training blocks.
PRIOR = {
    "menu": -4.0, "footer": -4.0, "header": -3.0, "aside": -4.0, "form": -4.0, "advert": -4.5, "comment": -4.5, "notice": -4.5, "hidden": -5.0, "article": 3.0, "content": 1.0,
    "bias": -1.0, "length": 2.5, "short": -0.5, "links": -4.0, "sentence": 0.8, "commas": 0.4, "first": -0.2, "last": -0.4, "paragraph": 0.8, "heading": 0.8, "item": -0.3,
}
FEATURES = tuple(PRIOR)
#: Features before `MARKUP` are mark-up, those from `LAYOUT` on the kind of element.
MARKUP, LAYOUT = FEATURES.index("bias"), FEATURES.index("paragraph")
#: How far fitting may move weights from the prior, and those of the kind of element.
SPREAD, LAYOUT_SPREAD = 1.0, 0.3
#: Characters of a block that can make a page be judged by a lower bar, and the most of them that may be links.
LONG, LINKED = 140, 0.2
#: The bounds of the sample that the classifier is fitted on: pages, and characters of one of them.
TRAIN_PAGES = 400
TRAIN_CHARS = 100_000
MOST_ODDS = 6.0
#: Elements of which a container is a group: their own container is the element around them.
ITEMS = HEADINGS | {"p", "li", "dt", "dd", "tr", "td", "th", "blockquote", "pre"}


@dataclass(frozen=True)
class Edges:
    """Capacities of the smoothness edges: between neighbours in the page, divided by 1 + steps / 2 in the DOM, and in a container."""

    adjacent: float = 1.6
    container: float = 0.6
    steps: int = 12


class Element:
    """An open element; ``kinds`` are the features of all elements around it, ``block`` the nearest block element."""

    __slots__ = ("name", "outer", "depth", "kinds", "block")

    def __init__(self, name: str, outer: Element | None, kinds: frozenset[str]):
        self.name, self.outer, self.kinds = name, outer, kinds
        self.depth = outer.depth + 1 if outer else 0
        self.block = self if name in BLOCK or outer is None else outer.block

    def container(self) -> Element:
        return self.outer.block if self.name in ITEMS and self.outer else self


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def kinds_of(name: str, attributes: str, outer: Element) -> frozenset[str]:
    """Features of an element: those around it, and those of its name and attributes."""
    found = set()
    kind = ELEMENTS.get(name)
    if kind and not (kind == "header" and "article" in outer.kinds):
        found.add(kind)
    if attributes and not attributes.isspace():
        words: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                words |= {w.lower() for w in TOKEN.findall(value)}
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                found.add("hidden")
        own = {WORDS[w] for w in words if w in WORDS}
        # A page's outermost elements may be named after anything; they hold the content too.
        found |= own & {"content"} if name in ("html", "body", "main", "article") else own
    if found - CONTENT:  # related-content and the like
        found.discard("content")
    # What is marked inside an article is no part of it.
    around = outer.kinds - CONTENT if found - CONTENT else outer.kinds
    return around | found if found - around else around


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in page order. Tags need not be closed, and the page may end anywhere."""
    root = Element("html", None, frozenset())
    stack = [root]
    opened: Counter[str] = Counter()
    out: list[Block] = []
    open_block: Block | None = None
    raw: list[str] = []
    at = links = 0

    def text(start: int, stop: int) -> None:
        nonlocal open_block
        if stop <= start or raw:
            return
        if open_block is None:
            if page[start:stop].isspace():
                return
            open_block = Block(stack[-1].block)
            out.append(open_block)
        open_block.parts.append(page[start:stop])
        if links:
            open_block.linked += stop - start

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            opened[e.name] -= 1
            links -= e.name == "a"
        del stack[k:]

    while True:
        m = TAG.search(page, at)
        if m is None:
            text(at, len(page))
            return out
        text(at, m.start())
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if raw:
                if name == raw[-1]:
                    raw.pop()
                elif name in ("head", "body", "html"):
                    raw.clear()
                continue
            if name in BLOCK:
                open_block = None
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if raw:
            if raw[-1] == "head" and name in BLOCK - {"html"}:
                raw.pop()  # a head that was not closed
            elif name in RAW and name not in VOID and not m[3].rstrip().endswith("/"):
                if name in OPAQUE:
                    at = _end_of(page, name, at)
                else:
                    raw.append(name)
                continue
            else:
                continue
        if name in RAW:
            if name in OPAQUE:
                at = _end_of(page, name, at)
            elif not m[3].rstrip().endswith("/"):
                raw.append(name)
            continue
        if name in ("br", "wbr"):
            if open_block is not None:
                open_block.parts.append(" " if name == "br" else "")
            continue
        if name in VOID:
            if name == "hr":
                open_block = None
            continue
        if name in BLOCK:
            open_block = None
            # A block ends an open paragraph and its inline elements.
            if stack[-1].block.name == "p":
                close(stack.index(stack[-1].block))
            own, within = CLOSES.get(name, ((), ()))
            if any(opened[x] for x in own):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in within:
                        break
                    if stack[k].name in own:
                        close(k)
                        break
        if name in ("html", "body") and len(stack) == 1:
            continue
        stack.append(Element(name, stack[-1], kinds_of(name, m[3], stack[-1])))
        opened[name] += 1
        links += name == "a"


def _end_of(page: str, name: str, at: int) -> int:
    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


class Page:
    """The blocks of a page that have text: their texts, features and edges."""

    def __init__(self, source: str, edges: Edges = Edges()):
        blocks = blocks_of(source)
        texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in blocks]
        keep = [i for i, t in enumerate(texts) if t]
        self.blocks, self.texts = [blocks[i] for i in keep], [texts[i] for i in keep]
        self.capacities = edges

    def features(self) -> np.ndarray:
        """Blocks x `FEATURES`."""
        n = len(self.blocks)
        out = np.zeros((n, len(FEATURES)))
        at = {name: k for k, name in enumerate(FEATURES)}
        out[:, at["bias"]] = 1
        for i, (block, text) in enumerate(zip(self.blocks, self.texts, strict=True)):
            row, name = out[i], block.parent.name
            for kind in block.parent.kinds:
                row[at[kind]] = 1
            row[at["length"]] = min(len(text) / 200, 1.5)
            row[at["short"]] = len(text) < 25
            row[at["links"]] = min(1.0, block.linked / max(sum(map(len, block.parts)), 1))
            row[at["sentence"]] = text[-1] in ".!?\u2026\"'\u201d\u00bb)\u3002"
            row[at["commas"]] = min(text.count(",") / 3, 1)
            row[at["paragraph"]] = name in ("p", "blockquote", "pre")
            row[at["heading"]] = name in HEADINGS
            row[at["item"]] = name in ("li", "td", "th", "dt", "dd")
        out[: max(1, n // 20), at["first"]] = 1
        out[n - max(1, n // 20) :, at["last"]] = 1
        return out

    def edges(self) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        last: dict[int, int] = {}
        for i, block in enumerate(self.blocks):
            if i:
                out.append((i - 1, i, self.capacities.adjacent / (1 + steps(self.blocks[i - 1].parent, block.parent, self.capacities.steps) / 2)))
            container = id(block.parent.container())
            if container in last:
                out.append((last[container], i, self.capacities.container))
            last[container] = i
        return out

    def labels(self) -> np.ndarray:
        """Weak labels: 1 under article or main, 0 under marked boilerplate, -1 unknown."""
        return np.array([0 if b.parent.kinds - CONTENT else 1 if "article" in b.parent.kinds else -1 for b in self.blocks], np.int64)

    def text(self, weights: np.ndarray) -> str:
        """The content blocks, joined by one line feed."""
        features = self.features()
        odds = np.clip(features @ weights, -MOST_ODDS, MOST_ODDS)
        content = minimum_cut(odds.tolist(), self.edges())
        if not any(content):
            body = [i for i, t in enumerate(self.texts) if len(t) >= LONG and features[i, FEATURES.index("links")] <= LINKED and not self.blocks[i].parent.kinds - CONTENT]
            if body:
                lift = max(1.0 - odds[body].max(), 0.0)
                content = minimum_cut(np.clip(odds + lift, -MOST_ODDS, MOST_ODDS).tolist(), self.edges())
        return "\n".join(t for t, c in zip(self.texts, content, strict=True) if c)


def steps(a: Element, b: Element, most: int) -> int:
    """Steps from one element to another along the DOM, ``most`` at most."""
    for taken in range(most):
        if a is b:
            return taken
        if a.depth < b.depth:
            a, b = b, a
        if a.outer is None:
            return most
        a = a.outer
    return most


#: The prior weights alone, as an array in order of `FEATURES`.
START = np.array([PRIOR[f] for f in FEATURES])


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of the logistic classifier: Newton's method on the log loss plus the distance to the prior weights.

    Of four blocks of a label one is shown as it is, one without its mark-up features, one without the kind of its element, and one
    with neither. The two labels weigh the same. What speaks for boilerplate by mark-up ends up stronger than a long paragraph's text.
    Without blocks of both labels the prior weights stand.
    """
    x, y = features[labels >= 0].copy(), labels[labels >= 0].astype(np.float64)
    if not len(y) or y.min() == y.max():
        return START.copy()
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        x[own[::2], :MARKUP] = 0
        x[np.concatenate([own[::4], own[1::4]]), LAYOUT:] = 0
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * min(len(y), 1000)
    hold = np.where(np.arange(len(START)) >= LAYOUT, 1 / LAYOUT_SPREAD**2, 1 / SPREAD**2)
    w = START.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (p - y)) + (w - START) * hold
        bend = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(bend, slope)
        w -= move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    at = {name: k for k, name in enumerate(FEATURES)}
    best = w[at["bias"]] + 1.5 * w[at["length"]] + max(w[at["sentence"]], 0) + max(w[at["commas"]], 0) + max(w[at["paragraph"]], 0)
    for name in FEATURES[:MARKUP]:
        if name not in CONTENT:
            w[at[name]] = min(w[at[name]], START[at[name]], -best - 0.5)
    return w


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (the largest such side).

    terminal: capacity from the source (positive) or to the sink (negative); edges: (u, v, capacity) both ways.
    Blocking flows: each round finds the distances from the nodes with excess, saturates all shortest
    ways to nodes with room, and takes time in proportion to the edges. Smoothness edges are weak against terminals, so
    flow goes a few steps only and rounds are few, at any length of a page.
    """
    n, tiny = len(terminal), 1e-9
    excess = [max(t, 0.0) for t in terminal]
    room = [max(-t, 0.0) for t in terminal]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    left: list[float] = []
    for u, v, c in edges:
        if u != v:
            near[u].append(len(to))
            near[v].append(len(to) + 1)
            to += (v, u)
            left += (c, c)
    while True:
        level = [-1] * n
        reached = [v for v in range(n) if excess[v] > tiny]
        for v in reached:
            level[v] = 0
        depth = 0
        while reached and not any(room[v] > tiny for v in reached):
            depth += 1
            following = []
            for u in reached:
                for e in near[u]:
                    v = to[e]
                    if level[v] < 0 and left[e] > tiny:
                        level[v] = depth
                        following.append(v)
            reached = following
        if not reached:
            break
        next_edge = [0] * n
        for source in range(n):
            if level[source] == 0:
                _push(source, depth, level, next_edge, excess, room, near, to, left)
    # Boilerplate is what can still reach the sink.
    away = [r > tiny for r in room]
    queue = deque(v for v in range(n) if away[v])
    while queue:
        v = queue.popleft()
        for e in near[v]:
            u = to[e]
            if not away[u] and left[e ^ 1] > tiny:
                away[u] = True
                queue.append(u)
    return [not a for a in away]


def _push(source: int, depth: int, level: list[int], next_edge: list[int], excess: list[float], room: list[float], near: list[list[int]], to: list[int], left: list[float]) -> None:
    """Send a source's excess along ways of ``depth`` steps to nodes with room, until no such way is left."""
    tiny = 1e-9
    path: list[int] = []
    u = source
    while excess[source] > tiny:
        if level[u] == depth:
            if room[u] > tiny:
                flow = min([excess[source], room[u], *(left[e] for e in path)])
                excess[source] -= flow
                room[u] -= flow
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                # Back to before the first edge that is full.
                full = next((k for k, e in enumerate(path) if left[e] <= tiny), len(path))
                u = to[path[full] ^ 1] if full < len(path) else u
                del path[full:]
                if level[u] < depth or room[u] > tiny:
                    continue
        elif next_edge[u] < len(near[u]):
            e = near[u][next_edge[u]]
            v = to[e]
            if level[v] == level[u] + 1 and left[e] > tiny:
                path.append(e)
                u = v
            else:
                next_edge[u] += 1
            continue
        # A dead end: take the last step back, and never again.
        if not path:
            return
        u = to[path.pop() ^ 1]
        next_edge[u] += 1


def main_text(page: str, weights: np.ndarray = START) -> str:
    """The main text of a page: its content blocks, joined by one line feed."""
    return Page(page).text(weights)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Weights fitted on the blocks of at most ``most`` different pages of `TRAIN_CHARS` or less.

    Pages are dealt to ``most`` buckets by a hash of all their columns; the least hash of each bucket is taken. Only
    hashes are shuffled to find them, at most ``most`` from each task, and then their pages.
    """
    rows = pages.where(F.length("html").between(1, TRAIN_CHARS)).select("html", F.xxhash64("url", "page_id", "html").alias("_hash"))
    least = [r["least"] for r in rows.groupBy(F.pmod("_hash", F.lit(most))).agg(F.min("_hash").alias("least")).collect()]
    if not least:
        return START.copy()
    taken = rows.where(F.col("_hash").isin(least)).groupBy("_hash").agg(F.first("html").alias("html")).orderBy("_hash")
    read = [p for p in map(Page, taken.toArrow()["html"].to_pylist()) if p.blocks]
    if not read:
        return START.copy()
    return fit(np.concatenate([p.features() for p in read]), np.concatenate([p.labels() for p in read]))


def _extract(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                text = [main_text(p, weights) if p else "" for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame, most: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages and pages without main text have an empty text. A page of any length is
    read whole, in time about in proportion to it. Repeated rows each come back; other columns are
    not read. ``most`` bounds the pages that the classifier is fitted on; a table without
    marked-up pages is judged by the prior weights.
    """
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract(train(rows, most)), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
