"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A linear classifier over a block's words, links,
punctuation and surroundings gives its log odds of being content, which become the
capacities of its edges to the two terminals. Neighbouring blocks, and consecutive blocks
of one parent, are joined by edges that are stronger the more of the DOM they share. The
minimum cut, found by maximum flow, separates content from boilerplate. Blocks whose own
odds outweigh all their edges are settled first, which leaves the same cut on a smaller
graph.

Scripts, styles, form controls and other elements without readable text are no blocks.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it
goes (an unclosed paragraph ends at the next block, a head at the first text or element that
may not stand in it, another element without readable text at the end of one around it); repeated rows are extracted each; an
empty table gives none; long pages are read whole. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what the tags of HTML mean
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template noscript svg math iframe object canvas audio video select textarea button title head".split())
_CONTROLS = frozenset("input select textarea button".split())
_IN_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# names of page parts that never hold the article, and those that an article inside overrules
_NEVER_TAGS = frozenset("nav footer aside menu dialog".split())
_NEVER_NAMES = frozenset("comment comments replies disqus respond feedback discussion related".split())
# words that stand beside the names of page parts and say nothing of their own
_PLAIN_NAMES = frozenset(
    "area articles bar block body bottom box button col column container content div group holder id inner items js left links "
    "list main outer page panel post posts reader right row section site stories text top user users visitor widget wrap wrapper".split()
)
_RARELY_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies copyright dialog footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended "
    "reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_NEVER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog form menu menubar".split())
_ARTICLE_NAMES = frozenset("article articlebody content entry maincontent post story".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?…。！？](\s|$)")

# weights of the linear classifier, in natural-log odds
_WEIGHTS = {
    "bias": -2.0,
    "words": 0.9,
    "sentence": 1.0,
    "links": -4.0,
    "paragraph": 0.8,
    "heading": 0.4,
    "item": -0.3,
    "sign": -8.0,
    "form": -6.0,
    "article": 2.5,
    "rarely": -5.0,
    "never": -7.0,
}
_LIMIT = 20.0
_NEAR = 2.5
_SIBLING = 1.0
# a form with so many words in paragraphs for each of its controls wraps a page
_FORM_WORDS = 25
_SCALE = 1000


@dataclass(slots=True)
class _Node:
    tag: str
    parent: _Node | None
    depth: int
    never: bool
    place: str  # article, rarely or nothing: the innermost part that says so
    form: list[int] | None = None  # controls and words in paragraphs of the innermost form


@dataclass(slots=True)
class Block:
    """A stretch of text between block boundaries."""

    node: _Node
    text: list[str] = field(default_factory=list)
    linked: int = 0

    def joined(self) -> str:
        return " ".join("".join(self.text).split())


class BlockReader(HTMLParser):
    """Splits a page into blocks in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._at = _Node("", None, 0, False, "")
        self._silent: list[str] = []  # an element without readable text and what is open in it
        self._links = 0
        self._open: Block | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_head(tag)
        if self._silent:
            if tag not in _VOID:
                self._silent.append(tag)
            return
        if self._at.form is not None and tag in _CONTROLS:
            self._at.form[0] += not any(k == "type" and v == "hidden" for k, v in attrs)
        if tag in _SILENT:
            self._silent.append(tag)
            return
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "", False)
            return
        if tag == "body" or tag == "html":
            return
        if tag in _INLINE:
            self._links += tag == "a"
            self._push(tag, attrs)
            return
        self._open = None
        if tag in _VOID:
            return
        if tag in _CLOSES_P:
            self._close("p")
        if tag in _SIBLINGS:
            self._close(*_SIBLINGS[tag])
        self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._end_head(tag)
        if self._silent:
            return
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._silent:
            if tag in self._silent:
                while self._silent.pop() != tag:
                    pass
                return
            if tag not in ("body", "html") and not self._is_open(tag):
                return
            self._silent.clear()
        if tag == "a":
            self._links = max(0, self._links - 1)
        if tag not in _INLINE:
            self._open = None
        node = self._at
        while node.parent is not None and node.tag != tag:
            if tag in _INLINE and node.tag not in _INLINE:
                return
            node = node.parent
        if node.parent is not None:
            self._at = node.parent

    def _end_head(self, tag: str) -> None:
        """End a head whose end tag is left out, before a start tag that may not stand in it."""
        if self._silent and self._silent[0] == "head" and (tag == "body" or len(self._silent) == 1 and tag not in _IN_HEAD):
            self._silent.clear()

    def _is_open(self, tag: str) -> bool:
        node = self._at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        return node.parent is not None

    def handle_data(self, data: str) -> None:
        if self._silent == ["head"] and data and not data.isspace():
            self._silent.clear()
        if not self._silent:
            self._text(data, self._links > 0)

    def _text(self, data: str, linked: bool) -> None:
        if self._open is None:
            if not data or data.isspace():
                return
            at = self._at
            while at.tag in _INLINE and at.parent is not None:
                at = at.parent
            self._open = Block(at)
            self.blocks.append(self._open)
        self._open.text.append(data)
        if linked:
            self._open.linked += len(data.split())

    def _close(self, *tags: str) -> None:
        """End the nearest open element of tags, unless another block contains it."""
        node = self._at
        while node.parent is not None:
            if node.tag in tags:
                self._at = node.parent
                self._links = 0
                return
            if node.tag not in _INLINE and node.tag != "p":
                return
            node = node.parent

    def _push(self, tag: str, attrs: list) -> None:
        up = self._at
        never, place = up.never, up.place
        form = [0, 0] if tag == "form" else up.form
        names: set[str] = set()
        unsure: set[str] = set()
        role = ""
        hidden = False
        for name, value in attrs:
            if name in ("class", "id", "itemprop") and value:
                for part in value.split():
                    words = {x.lower() for x in _NAME.findall(part)} | {part.lower()}
                    names |= words
                    # a name with a word of another kind may speak of the text itself
                    if words - {part.lower()} - _PLAIN_NAMES - _NEVER_NAMES - _RARELY_NAMES:
                        unsure |= words & _NEVER_NAMES
            elif name == "role":
                role = (value or "").lower()
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
        if tag in _NEVER_TAGS or (names & _NEVER_NAMES) - unsure or role in _NEVER_ROLES or hidden:
            never = True
        elif names & _RARELY_NAMES or role == "banner" or (tag == "header" and place != "article"):
            place = "rarely"
        elif tag in ("article", "main") or role in ("main", "article") or names & _ARTICLE_NAMES and place != "rarely":
            place = "article"
        self._at = _Node(tag, up, up.depth + 1, never, place, form)


def log_odds(block: Block, text: str) -> float:
    """The classifier's natural-log odds that a block is content."""
    words = len(text.split())
    node, w = block.node, _WEIGHTS
    score = w["bias"] + w["words"] * math.log1p(words) + w["links"] * min(1.0, block.linked / max(words, 1))
    if _SENTENCE.search(text):
        score += w["sentence"]
    if node.tag in ("p", "blockquote", "pre", "figcaption"):
        score += w["paragraph"]
    elif node.tag in _HEADINGS:
        score += w["heading"]
    elif node.tag in ("li", "td", "th", "dt", "dd"):
        score += w["item"]
    if "©" in text:
        score += w["sign"]
    if node.form is not None and node.form[1] < _FORM_WORDS * (node.form[0] + 1):
        score += w["form"]
    if node.never:
        score += w["never"]
    elif node.place:
        score += w[node.place]
    return max(-_LIMIT, min(_LIMIT, score))


def _shared(a: _Node, b: _Node) -> float:
    """Share of the shallower block's ancestors, itself and the page included, that both have.

    Between neighbouring blocks the steps are the elements that end and begin there, so a
    page's neighbours take no more steps than it has elements.
    """
    least = min(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return (a.depth + 1) / (least + 1)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours on the page and siblings in the DOM."""
    found = []
    latest: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1].node
            # a heading goes with what follows, and parts from what stands before
            tie = (2.0 if before.tag in _HEADINGS else 1.0) * (0.5 if block.node.tag in _HEADINGS else 1.0)
            found.append((i - 1, i, round(_SCALE * _NEAR * tie * _shared(before, block.node))))
        parent = id(block.node.parent or block.node)
        if parent in latest and latest[parent] < i - 1:
            found.append((latest[parent], i, round(_SCALE * _SIBLING)))
        latest[parent] = i
    return [e for e in found if e[2]]


def minimum_cut(odds: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes the least cut leaves with the source; positive odds pull to it.

    A node whose odds are at least all its undecided edges keeps their side whatever the
    others do; the edges to it then pull its neighbours. Maximum flow decides the rest.
    """
    near: list[dict[int, int]] = [{} for _ in odds]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    pull = list(odds)
    side: list[bool | None] = [None] * len(odds)
    loose = [sum(n.values()) for n in near]
    ready = deque(range(len(odds)))
    while ready:
        i = ready.popleft()
        if side[i] is not None or abs(pull[i]) < loose[i]:
            continue
        side[i] = pull[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                pull[j] += c if side[i] else -c
                loose[j] -= c
                ready.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        number = {i: n for n, i in enumerate(rest)}
        left = [(number[a], number[b], c) for a, b, c in edges if a in number and b in number]
        for i, found in zip(rest, _flow_cut([pull[i] for i in rest], left), strict=True):
            side[i] = found
    return [bool(s) for s in side]


def _flow_cut(pull: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of the least cut, by blocking flows along shortest paths."""
    n = len(pull)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, p in enumerate(pull):
        if p > 0:
            join(source, i, p, 0)
        elif p < 0:
            join(i, sink, -p, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [i in level for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path.clear()
                at = source
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] and level.get(to[e]) == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(out[at]):
                path.append(out[at][tried[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                at = to[path.pop() ^ 1]
                tried[at] += 1


def main_text(html: str | None) -> str:
    """The blocks on the content side of the cut, joined by one space."""
    if not html:
        return ""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    blocks, texts = [], []
    for block in reader.blocks:
        text = block.joined()
        if text:
            blocks.append(block)
            texts.append(text)
    for block, text in zip(blocks, texts, strict=True):
        if block.node.form is not None and block.node.tag in ("p", "blockquote", "pre"):
            block.node.form[1] += len(text.split()) - block.linked
    odds = [round(_SCALE * log_odds(b, t)) for b, t in zip(blocks, texts, strict=True)]
    side = minimum_cut(odds, edges_of(blocks))
    return " ".join(t for t, s in zip(texts, side, strict=True) if s)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (its code points)."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column("html")]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            arrays.append(pa.array([len(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
