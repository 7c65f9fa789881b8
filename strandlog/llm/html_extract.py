"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: stretches of text between the tags that break lines. Each block gets log-odds of being
content: those of a classifier (how its text looks, how much of the page its container holds, whether the elements
around it are called like content or like boilerplate), bounded by ``LOOKS``, and ``SECTION`` for or against by the
sectioning element that it lies in. Either can outweigh the other. Neighbouring blocks are tied by an edge that is
stronger the nearer they are in the element tree, and so are a container's consecutive children. The cheapest labelling
is a minimum cut: log-odds are capacities from the source (content) or to the sink (boilerplate), ties are capacities
between blocks, and a block goes with its surroundings where the ties outweigh its own odds. Blocks whose log-odds
outweigh all their ties are settled first, which is exact; max-flow runs on each connected rest.

The classifier is a logistic regression, trained anew on the blocks of at most ``SAMPLE`` pages, those of least hashed
page_id. Its labels need no names: on pages with an article or main element, what lies in it is content and what lies
outside, or in a nav, aside or footer within, is not. What elements are called is a feature whose weight is learned;
the ridge pulls all weights towards ``PRIOR``, which stands alone where no page tells.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 500
TIE = 3.2
LOOKS = 3.0
SECTION = 2.5
RIDGE = 20.0

_BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template title textarea select option button iframe datalist".split())
_CLOSES_P = _BREAKS - {"body", "html", "head", "legend", "summary", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "figcaption"}
_CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table menu div section article".split())
_ITEMS = frozenset("li dt dd".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INNER = frozenset("article main".split())
_OUTER = frozenset("nav footer aside menu dialog header form".split())
# fixed values: what elements are called that hold content, and that don't
_GOOD_NAMES = frozenset("article articlebody content entry main maincontent post postbody story text".split())
_BAD_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts advertorial alert author banner bio breadcrumb breadcrumbs byline comment commentlist comments "
    "consent cookie cookies copyright discussion disqus dropdown feedback flash footer form gdpr header legal login masthead menu menubar message "
    "meta modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion "
    "rating reactions reader recommended related remark replies reply respond response responses search share sharing sidebar sidenav signin signup skip social sponsor sponsored "
    "subscribe subscription taboola tags toc toolbar topbar trending warning widget widgets".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")


class _Element:
    __slots__ = ("tag", "outer", "depth", "named", "chars", "holds", "breaking", "list")

    def __init__(self, tag: str, outer: _Element | None, named: int):
        self.tag, self.outer, self.named = tag, outer, named
        self.depth = outer.depth + 1 if outer else 0
        self.chars = 0  # of the blocks in it, at any depth
        self.holds = False  # an h1, a main or an article is in it
        self.breaking = self if outer is None or tag in _BREAKS else outer.breaking  # the nearest one that breaks lines
        self.list = outer.list if tag in _ITEMS and outer else self  # for an item, what it is an item of


class _Block:
    __slots__ = ("text", "linked", "at", "parts", "names", "section")

    def __init__(self, at: _Element):
        self.at = at
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""
        self.names = self.section = 0


class _Reader(HTMLParser):
    """Collects the blocks of a page and the elements that they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", None, 0)
        self.elements: list[_Element] = []  # but for the root, outer ones first
        self.blocks: list[_Block] = []
        self.stack: list[_Element] = [self.root]
        self.opened: Counter = Counter()
        self.open: _Block | None = None
        self.silent = self.links = 0

    def _break(self):
        b = self.open
        if b is not None:
            b.text = " ".join("".join(b.parts).split())
            b.parts = []
            if b.text:
                self.blocks.append(b)
            self.open = None

    def _pop(self, k: int):
        for e in self.stack[k:]:
            self.opened[e.tag] -= 1
            self.silent -= e.tag in _SILENT
            self.links -= e.tag == "a"
        del self.stack[k:]

    def _close_before(self, tags: tuple):
        """An open element of these tags ends where another begins, unless a list or container lies between."""
        if any(self.opened[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    self._pop(k)
                    break
                if self.stack[k].tag in _LISTS:
                    break

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS:
            self._break()
        elif tag == "br" and self.open is not None:
            self.open.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            self._close_before(("p",))
        if tag in _CLOSES_OWN:
            self._close_before(_CLOSES_OWN[tag])
        named = 0
        if tag not in ("body", "html"):
            names = {x.lower() for k, v in attrs if k in ("class", "id", "role") and v for x in _NAME.findall(v)}
            named = bool(names & _GOOD_NAMES) - bool(names & _BAD_NAMES)  # 0 where they contradict each other
        element = _Element(tag, self.stack[-1], named)
        if tag in _INNER and named >= 0 or tag == "h1":
            e = element.outer
            while e is not None and not e.holds:
                e.holds, e = True, e.outer
        self.stack.append(element)
        self.elements.append(element)
        self.opened[tag] += 1
        self.silent += tag in _SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack[-1].tag == tag:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag in _BREAKS:
            self._break()
        if self.opened[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._pop(k)
                    return

    def handle_data(self, data):
        if self.silent:
            return
        if self.open is None:
            if not data.strip():
                return
            self.open = _Block(self.stack[-1])
        self.open.parts.append(data)
        if self.links:
            self.open.linked += len(data)


def blocks_of(html: str | None) -> list[_Block]:
    """The blocks of a page, with what is known of the elements around each.

    ``section``: 1 within an article or main element, -1 in a nav, footer, aside, menu, dialog, header or form that is
    nearer, or outside every article or main of a page that has one; else 0. ``names``: 1 or -1 as the nearest element
    with a telling name says. What holds more than half of the page's text, or (but for nav, footer, menu, dialog and
    header) an h1, main or article, is no boilerplate by its tag or name. Names outside the nearest article or main
    don't count. An element left open, a button too, ends with what it is in. Work is linear in elements, however deep.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._break()
    blocks, known = reader.blocks, {}
    for b in blocks:
        b.at.chars += len(b.text)
    for e in reversed(reader.elements):
        e.outer.chars += e.chars
    most = reader.root.chars / 2

    def about(e: _Element) -> tuple[int, int]:
        """section and names of what lies right in e."""
        way = []
        while e is not None and id(e) not in known:
            way.append(e)
            e = e.outer
        section, names = known[id(e)] if e is not None else (0, 0)
        for e in reversed(way):
            main = e.chars > most or e.holds
            if e.tag in _INNER and e.named >= 0:
                section, names = 1, 0
            elif e.tag in _OUTER and not (e.chars > most if e.tag != "form" and e.tag != "aside" else main) and not (e.tag == "header" and section > 0):
                section = -1
            if e.named and not (e.named < 0 and main):
                names = e.named
            known[id(e)] = section, names
        return section, names

    for b in blocks:
        b.section, b.names = about(b.at)
    if any(b.section > 0 for b in blocks):
        for b in blocks:
            b.section = b.section or -1
    return blocks


def _up(e: _Element) -> _Element:
    """The nearest element, e itself included, that breaks lines; for an item, the list that it is in."""
    return e.breaking.list


#: Weights of the looks that training starts from, in the order of ``_looks_of``.
PRIOR = (-0.5, 0.8, -4.0, 0.5, -0.5, 1.0, 0.5, 1.5, 2.0, -3.0)


def _looks_of(blocks: list[_Block]) -> np.ndarray:
    """A row for each block: one, length, share of linked text, sentences, list or table cell, paragraph, heading, share
    of the page's text that lies in the same container's own blocks, good name, bad name."""
    chars, own = 0, Counter()
    at = [_up(b.at) for b in blocks]
    for b, e in zip(blocks, at):
        chars += len(b.text)
        own[id(e.outer)] += len(b.text)
    return np.array([
        (1.0, math.log1p(len(b.text)) - 4, min(1.0, b.linked / len(b.text)), min(1.0, 40 * len(_SENTENCE.findall(b.text)) / len(b.text)), e.tag in ("ul", "ol", "dl", "td", "th"),
         e.tag in ("p", "blockquote", "pre"), e.tag in _HEADINGS, own[id(e.outer)] / chars - 0.5, b.names > 0, b.names < 0)
        for b, e in zip(blocks, at)
    ], dtype=float).reshape(-1, len(PRIOR))


#: The looks that come from tags and names; each page is learned from with and without them, so that pages which use
#: other tags are judged by the rest.
_TAGGED = [4, 5, 6, 8, 9]


def train(pages: list[str], ridge: float = RIDGE) -> list[float]:
    """Weights of the looks, by Newton's method with a ridge towards PRIOR. Both labels weigh the same in all."""
    x, y = [], []
    for html in pages:
        blocks = blocks_of(html)
        if any(b.section > 0 for b in blocks):
            looks = _looks_of(blocks)
            bare = looks.copy()
            bare[:, _TAGGED] = 0
            x += [looks, bare]
            y += 2 * [b.section > 0 for b in blocks]
    prior, y = np.array(PRIOR), np.array(y, dtype=float)
    if not len(y) or y.min() == y.max():
        return list(PRIOR)
    x, share = np.concatenate(x), y.mean()
    each = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * min(1.0, 2_000 / len(y))
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (each * (y - p)) - ridge * (w - prior))
        w = w + step / max(1.0, float(np.abs(step).max()) / 4)
    return [float(v) for v in w]


def odds_of(blocks: list[_Block], weights) -> list[float]:
    """The log-odds of each block: its looks within LOOKS, and SECTION for or against."""
    looks = np.clip(_looks_of(blocks) @ np.array(weights), -LOOKS, LOOKS)
    return [float(x) + SECTION * b.section for x, b in zip(looks, blocks)]


def _steps(a: _Element, b: _Element) -> int:
    """How far two elements are apart in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.outer
        else:
            b = b.outer
        n += 1
    return n


def _ties(blocks: list[_Block]) -> dict[tuple[int, int], float]:
    """Edges between consecutive blocks, half as strong where sections or names tell them apart, and between
    consecutive blocks of one container that these don't tell apart."""
    ties: dict[tuple[int, int], float] = {}
    last_in: dict[tuple, int] = {}
    at = [_up(b.at) for b in blocks]
    for i, e in enumerate(at):
        before = {i - 1} if i else set()
        holder = id(e.outer), blocks[i].section, blocks[i].names
        if holder in last_in:
            before.add(last_in[holder])
        last_in[holder] = i
        for j in before:
            apart = blocks[j].section != blocks[i].section or blocks[j].names != blocks[i].names
            ties[j, i] = TIE / max(2, _steps(at[j], e) ** 2) / (2 if apart else 1)
    return ties


def minimum_cut(odds: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: the labelling of least cost, where a node pays |odds| for
    the label that its odds are against and a tie pays its weight if its ends differ. Even odds go to the sink's side."""
    near: list[dict[int, float]] = [{} for _ in odds]
    for (i, j), w in ties.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    odds, label = list(odds), [None] * len(odds)
    waiting = deque(range(len(odds)))
    while waiting:  # a node that outweighs its ties is settled, and its ties become its neighbours' odds
        i = waiting.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                waiting.append(j)
            near[i] = {}
    for i in range(len(odds)):
        if label[i] is None:  # a connected rest
            rest, queue = {i}, deque([i])
            while queue:
                for j in near[queue.popleft()]:
                    if j not in rest:
                        rest.add(j)
                        queue.append(j)
            inside = _reach_after_flow(sorted(rest), odds, near)
            for j in rest:
                label[j] = j in inside
    return label


def _reach_after_flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that the source still reaches when no augmenting path is left. Paths of one length are found together:
    levels from the source, then a walk forward along them that never tries an edge twice."""
    room: dict = {"s": {i: odds[i] for i in nodes if odds[i] > 0}, "t": {}}
    for i in nodes:
        room[i] = dict(near[i])
        if odds[i] < 0:
            room[i]["t"] = -odds[i]
    while True:
        level: dict = {"s": 0}
        queue = deque(["s"])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if "t" not in level:
            return {v for v in level if v != "s"}
        ahead = {u: list(room[u]) for u in level}
        path = ["s"]
        while path:
            u = path[-1]
            if u == "t":
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    if x != "s" and y != "t":
                        room[y][x] = room[y].get(x, 0.0) + flow
                path = ["s"]
            else:
                while ahead[u] and not (room[u].get(ahead[u][-1], 0.0) > 1e-9 and level.get(ahead[u][-1], 0) == level[u] + 1):
                    ahead[u].pop()
                if ahead[u]:
                    path.append(ahead[u][-1])
                else:
                    path.pop()
                    if path:
                        ahead[path[-1]].pop()


def main_text(html: str | None, weights) -> str:
    """The content blocks in page order, joined by an empty line."""
    blocks = blocks_of(html)
    kept = minimum_cut(odds_of(blocks, weights), _ties(blocks)) if blocks else []
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def _sampled(pages: DataFrame, sample: int) -> list[str]:
    """The html of the pages of least hashed page_id (then least hash of html), whatever the partitioning; of equal
    rows one. Ids and hashes alone are sorted, the texts read after."""
    hashed = pages.filter("html is not null and page_id is not null").select("page_id", "html", F.xxhash64("html").alias("html_hash"))
    least = hashed.select("page_id", "html_hash").orderBy(F.xxhash64("page_id"), "page_id", "html_hash").limit(sample).collect()
    some = hashed.filter(F.col("page_id").isin([r.page_id for r in least]) & F.col("html_hash").isin([r.html_hash for r in least]))
    found = {(r.page_id, r.html_hash): r.html for r in some.groupBy("page_id", "html_hash").agg(F.first("html").alias("html")).collect()}
    return [found[k] for k in sorted({(r.page_id, r.html_hash) for r in least})]


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty html, or one without text, has an empty text; null ids and urls stay. Rows with the same page_id, or
    equal altogether, are pages of their own. Other columns are ignored. An empty table gives an empty one.
    """
    weights = train(_sampled(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), weights) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
