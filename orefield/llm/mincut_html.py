"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text, each with its place among the elements.  A
linear classifier, fitted on labelled sample pages (see page_samples), gives
every block a score for content or against it, which becomes the capacity of
its edge from the source or to the sink.  Blocks that follow each other, and
blocks of one parent, are joined by smoothness edges, stronger the nearer they
stand among the elements.  The minimum cut, found by a maximum flow, separates
content from boilerplate.

What tags, roles and names of elements say is nothing but features of the
classifier, and of elements that hold the page's anchor it is void: the anchor
is the element with most of the running text, so a wrapper's name can't cost a
page its article.
"""

from __future__ import annotations

import functools
import math
import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm import common as c

RAW = frozenset("script style title noscript iframe xmp noembed noframes plaintext template annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAVES = frozenset("p li dt dd td th caption figcaption blockquote pre address summary span a b i em strong small time".split()) | HEADINGS
#: Elements that seldom hold the article, and roles that say so.
OUTSIDE = frozenset("nav footer aside form menu dialog button select textarea label fieldset search header".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar tablist".split())
#: Names in class and id, or their beginnings, that are common outside of the article.
OUTSIDE_NAMES = frozenset("ad ads adv banner header nav menu side sidebar rail share sharing social related recommended popup modal overlay widget toolbar pagination pager login signup signin copyright legal disclaimer notice alert topbar masthead tags meta search consent gdpr paywall outbrain taboola form respond reply replies discussion disqus feedback trending teaser teasers skip byline".split())
OUTSIDE_STEMS = ("advert", "sponsor", "newsletter", "subscri", "cookie", "breadcrumb", "comment", "footer", "navbar", "navigation", "sidebar", "promo", "recommend")
INSIDE_NAMES = frozenset("content article post entry story text body main prose".split())
#: Last parts of a name that say nothing.
TAILS = frozenset("container wrapper wrap box list item items area section block buttons button links link bar inner outer thread slot unit row col column group panel top bottom left right".split())
#: A name is denied by one of these before it.
DENIED = frozenset("no non not without has with hide hidden is".split())

#: Smoothness between neighbours of one parent, of near and of far elements; and between a block and the next one of its parent.
SAME_PARENT, NEAR, APART, SIBLING = 0.8, 0.4, 0.1, 0.4
SCALE = 100
#: Words from which a block counts as running text, if no more than a third of it is links.
RUNNING_WORDS = 8
#: What the text of an element counts for the anchor, for each element around it that speaks against it.
CUED = 0.1

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


# what an element says of the text in it
TAG, ROLE, STRONG, WEAK, LEAF_STRONG, LEAF_WEAK, HIDDEN, INSIDE = (1 << k for k in range(8))
CUES = TAG | ROLE | STRONG | WEAK | HIDDEN

FEATURES = "bias words running links sentence heading title anchor landmark inside tag role strong weak leaf_strong leaf_weak hidden parent_words parent_links before after item sign away weak_running".split()


@dataclass
class Block:
    """A run of text without a block's border in it."""

    element: int  # the innermost one that it begins in
    parent: int  # the innermost one that isn't inline
    depth: int
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    words: int = 0
    features: list[float] = field(default_factory=list)


def _cues(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element's attributes say, and whether its role is main."""
    flags, main = 0, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            flags |= HIDDEN
        elif name == "role":
            role = value.strip().lower()
            main |= role == "main"
            if role in OUTSIDE_ROLES:
                flags |= ROLE
        elif name in ("class", "id") and tag not in ("html", "body"):
            for word in value.split():
                names = [x.lower() for x in _NAME.findall(word)]
                if not names or DENIED.intersection(names):
                    continue
                while len(names) > 1 and names[-1] in TAILS:
                    names.pop()
                said = [x in OUTSIDE_NAMES or x.startswith(OUTSIDE_STEMS) for x in names]
                if said[-1]:
                    flags |= LEAF_STRONG if tag in LEAVES else STRONG
                elif any(said):
                    flags |= LEAF_WEAK if tag in LEAVES else WEAK
                elif names[-1] in INSIDE_NAMES:
                    flags |= INSIDE
    return flags, main


class _Reader:
    """Elements and blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        # of each element, by number; 0 is the page
        self.parents = [0]
        self.tags = [""]
        self.flags = [0]
        self.main = [False]
        self.open: list[tuple[str, int, bool]] = []  # tag, number, link
        self.at: dict[str, list[int]] = {}  # places of each tag in open
        self.border = [-1]  # places of elements that are not inline
        self.current: Block | None = None

    def text(self, raw: str) -> None:
        if self.current is None:
            if not raw.strip():
                return
            parent = self.open[self.border[-1]][1] if self.border[-1] >= 0 else 0
            self.current = Block(self.open[-1][1] if self.open else 0, parent, len(self.border))
            self.blocks.append(self.current)
        self.current.parts.append(raw)
        if self.open and self.open[-1][2]:
            self.current.link_chars += len(raw.strip())

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self.current = None
            if tag not in ("html", "body"):
                self.close_implied(tag)
        elif tag == "br":
            if self.current is not None:
                self.current.parts.append("\n")
            return
        if tag in VOID or (attributes.endswith("/") and (self.at.get("svg") or self.at.get("math"))):
            return
        flags, main = _cues(tag, attributes) if attributes else (0, False)
        if tag in OUTSIDE:
            flags |= TAG
        number = len(self.parents)
        self.parents.append(self.open[-1][1] if self.open else 0)
        self.tags.append(tag)
        self.flags.append(flags)
        self.main.append(main or tag == "main")
        self.at.setdefault(tag, []).append(len(self.open))
        if block:
            self.border.append(len(self.open))
        self.open.append((tag, number, tag == "a" or (bool(self.open) and self.open[-1][2])))

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close_implied(self, tag: str) -> None:
        """Ends of elements that a start tag implies."""
        if tag not in ("td", "th", "tr", "caption", "option", "label", "button"):
            p = self.last("p")
            if p > self.last("table", "td", "th", "caption", "button"):
                self.pop_to(p)
        for own, others, scope in (("li", ("li",), ("ul", "ol", "menu", "dir")), ("dt", ("dt", "dd"), ("dl",)), ("dd", ("dt", "dd"), ("dl",)), ("td", ("td", "th"), ("tr", "table")), ("th", ("td", "th"), ("tr", "table")), ("tr", ("tr",), ("table", "tbody", "thead", "tfoot")), ("option", ("option",), ("select",))):
            if tag == own and (k := self.last(*others)) > self.last(*scope):
                self.pop_to(k)
        if tag in HEADINGS and (k := self.last(*HEADINGS)) >= 0 and k == self.border[-1]:
            self.pop_to(k)

    def end(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.current = None
        k = self.last(tag)
        if k >= 0 and (block or self.border[-1] < k) and not (tag == "p" and self.last("td", "th", "button") > k):
            self.pop_to(k)

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            if len(self.border) > 1 and self.border[-1] == len(self.open):
                self.border.pop()



def blocks_of(html: str) -> list[Block]:
    """The blocks of a page that have text, in order, with white space folded, and their features."""
    r, at, n = _Reader(), 0, len(html)
    while at < n:
        k = html.find("<", at)
        m = None
        while k >= 0:
            m = _TOKEN.match(html, k)
            if m:
                break
            k = html.find("<", k + 1)
        if k < 0:
            k = n
        if k > at:
            r.text(html[at:k])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            r.end(tag)
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
        else:
            r.start(tag, m[3])
    for b in r.blocks:
        b.text = " ".join(unescape("".join(b.parts)).split())
    r.blocks = [b for b in r.blocks if b.text]
    _describe(r)
    return r.blocks


def _describe(r: _Reader) -> None:
    """Find the anchor and set the features of all blocks; the work grows with elements and blocks, not with depth."""
    n = len(r.parents)
    landmark, flags, count = [0] * n, r.flags, [0] * n
    for e in range(1, n):
        p = r.parents[e]
        landmark[e] = landmark[p] or (e if r.main[e] or r.tags[e] == "article" else 0)
        if landmark[p] and r.tags[e] == "header":  # an article's own
            flags[e] &= ~TAG
        count[e] = count[p] + bool(flags[e] & (CUES | LEAF_STRONG))
    credit = [0.0] * n
    words, chars, links, held = [0] * n, [0] * n, [0] * n, [0] * n
    box = []  # the element that a block is one of several in
    for b in r.blocks:
        b.words = b.text.count(" ") + 1
        box.append(r.parents[b.parent] if r.tags[b.parent] in LEAVES else b.parent)
        for x, v in ((words, b.words), (chars, len(b.text)), (links, min(b.link_chars, len(b.text))), (held, 1)):
            x[box[-1]] += v
        if 3 * b.link_chars < len(b.text):
            own = len(b.text) * (1.0 if b.words >= RUNNING_WORDS else 0.5) * CUED ** min(count[b.element], 40)
            if landmark[b.element]:
                credit[landmark[b.element]] += 4 * own
            else:
                credit[box[-1]] += own
                credit[r.parents[box[-1]]] += own / 2
    anchor = max(range(n), key=lambda e: (credit[e], -e)) if any(credit) else 0
    holds = [False] * n
    e = anchor
    while e:
        holds[e] = True
        e = r.parents[e]
    holds[0] = True
    said, inside, within, away = [0] * n, [False] * n, [False] * n, [0] * n
    within[0] = not anchor
    for e in range(1, n):
        p = r.parents[e]
        within[e] = within[p] or e == anchor
        inside[e] = inside[p] or bool(flags[e] & INSIDE)
        said[e] = 0 if holds[e] else flags[e] | said[p]
        away[e] = 0 if holds[e] or within[e] else away[p] + 1
    mine = [k for k, b in enumerate(r.blocks) if within[b.element]]
    first, last = (mine[0], mine[-1]) if mine else (0, len(r.blocks))
    for k, b in enumerate(r.blocks):
        s, size, x = said[b.element], len(b.text), box[k]
        share = min(1.0, b.link_chars / size)
        tag = r.tags[b.parent]
        b.features = [
            1.0, min(math.log1p(b.words) / 4, 1.5), float(b.words >= RUNNING_WORDS and 3 * share < 1), share, float(b.text[-1] in ".!?…»\"”。！？"), float(tag in HEADINGS), float(tag == "h1"),
            float(within[b.element]), float(landmark[b.element] > 0), float(inside[b.element]),
            *(float(bool(s & f)) for f in (TAG, ROLE, STRONG, WEAK, LEAF_STRONG, LEAF_WEAK, HIDDEN)),
            min(math.log1p(words[x] / held[x]) / 4, 1.5), links[x] / max(chars[x], 1), float(k < first), float(k > last), float(tag in ("li", "dt", "dd", "td", "th")), float("©" in b.text and b.words < 30), min(away[b.element], 4) / 4, float(bool(s & (WEAK | LEAF_WEAK)) and b.words >= RUNNING_WORDS and 3 * share < 1 and within[b.element]),
        ]


#: Sample pages that the classifier is fitted on, and the weight of its penalty.
SAMPLE_PAGES, PENALTY = 600, 1.0


@functools.cache
def fitted(n_pages: int = SAMPLE_PAGES, seed: int = 11) -> np.ndarray:
    """The weights of a logistic regression, by Newton's method, over the blocks of the sample pages; the same on every run."""
    from orefield.llm.page_samples import labelled_pages

    x, y = [], []
    for html, content in labelled_pages(n_pages, seed):
        for b in blocks_of(html):
            x.append(b.features)
            y.append(b.text in content)
    x, y = np.array(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + PENALTY * np.eye(len(w)), x.T @ (p - y) + PENALTY * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source's side of a minimum cut: nodes of positive score hang on the source with it, of negative on the sink; edges are (u, v, capacity) both ways.

    Dinic's algorithm.  Of several minimum cuts it gives the one with the
    fewest nodes on the source's side.
    """
    n = len(scores)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def add(u: int, v: int, forth: int, back: int) -> None:
        head[u].append(len(to))
        head[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((forth, back))

    for v, x in enumerate(scores):
        if x > 0:
            add(s, v, x, 0)
        elif x < 0:
            add(v, t, -x, 0)
    for u, v, x in edges:
        add(u, v, x, x)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                first = 0
                for i, e in enumerate(path):
                    cap[e] -= least
                    cap[e ^ 1] += least
                for i, e in enumerate(path):
                    if not cap[e]:
                        first = i
                        break
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while place[u] < len(head[u]):
                e = head[u][place[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                place[u] += 1
            if place[u] < len(head[u]):
                path.append(head[u][place[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                place[u] += 1
            else:
                break


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    scores = np.rint(SCALE * (np.array([b.features for b in blocks]) @ weights)).astype(int).tolist()
    if all(x <= 0 for x in scores):
        return [False] * len(blocks)
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            edges.append((k - 1, k, round(SCALE * (SAME_PARENT if a.parent == b.parent else NEAR if a.depth == b.depth else APART))))
        if (j := last.get(b.parent, k)) < k - 1:
            edges.append((j, k, round(SCALE * SIBLING)))
        last[b.parent] = k
    return min_cut(scores, edges)


def extract(html: str | None, weights: np.ndarray | None = None) -> str:
    """The main text of a page; empty for null."""
    blocks = blocks_of(html or "")
    return " ".join(b.text for b, ok in zip(blocks, label(blocks, fitted() if weights is None else weights), strict=True) if ok)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages, from the whole of its html.

    Character references are decoded, white space within a block is one space,
    and content blocks are joined by one.  A null page, or one without content,
    has an empty text.  Repeated rows have a row each; ids and addresses are
    passed through, null or not.  Other columns are not looked at.  The
    classifier is fitted on the driver, on sample pages only (fitted).
    """
    c.importable(pages.sparkSession)
    weights = fitted()

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {x.name: x.dataType.simpleString() for x in own.schema}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
