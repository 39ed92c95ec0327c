"""Main-text extraction by minimum cut.

A page is cut into blocks of text at its block-level tags. The graph's nodes
are the blocks and the elements that hold them. A classifier gives each block
log-odds of being content from its text alone (words, sentence ends, share of
link text, tag), and each element from what it is (article, navigation, words
of its class); an element's log-odds count for every block that it holds. They
are the capacities of edges to the two terminals. Smoothness edges join a block
to its element, to the block before it and to the last one in the same element
(adjacency), and an element to the one around it (DOM proximity); where such an
edge leaves an element with evidence against it, it is weak. The minimum cut is
the labelling of least total cost: short blocks follow the element that they
stand in, and long prose outweighs weak evidence against its element.

Class words are evidence and decide nothing alone: they count less where a name
mixes them with words of an article, not at all in names such as ``no-sidebar``
or ``with-comments``, and less the larger the share of the page's prose is that
the element holds; an element that holds nearly all of it is the page itself.

Defined cases: a null or empty html, or one without content, gives an empty
text; broken markup is read as far as it goes (unclosed tags end with their
parent, an unfinished last tag is dropped); every page is extracted whole,
however long, repeated rows and null page_ids too; other columns are ignored.
Ties: where two labellings cost the same, the one with less content is taken.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Never text for the reader.
SILENT = frozenset("head title script style template noscript iframe object svg canvas audio video select option textarea button datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXT_TAGS = HEADINGS | {"p", "pre", "blockquote", "dd", "dt", "figcaption", "td", "th", "li"}
#: Tags that hold a block's text but group nothing: such a block belongs to the element around them.
PLAIN_TAGS = TEXT_TAGS | {"tr", "tbody", "thead", "tfoot", "caption"}
#: Log-odds that an element gives to each of its blocks.
ELEMENTS = {"article": 5.0, "main": 5.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "menu": -9.0, "dialog": -9.0, "search": -9.0, "form": -8.0, "fieldset": -8.0, "header": -7.0}
ROLES = {"navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "form": -8.0, "dialog": -9.0, "alert": -9.0, "main": 5.0, "article": 5.0}
#: Parts of class names and ids that speak against an element; those of comments and adverts do so in any company.
SURE_MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter outbrain taboola".split())
MARKS = SURE_MARKS | frozenset(
    "banner banners billboard breadcrumb breadcrumbs byline discussion footer foot header masthead topbar menu menus nav navbar navigation navigationbar pager pagination "
    "subscribe subscription signup login notice notices alert announcement popup modal overlay paywall promo promoted promotion related recommended "
    "recommendations share sharing social sidebar sidebars aside widget widgets skip sponsor sponsored toolbar tags complementary contentinfo".split()
)
GOOD_MARKS = frozenset("article content post entry main body story text prose".split())
#: A name that begins or ends so tells what is or isn't there, not what the element is.
TELLING = re.compile(r"^(no|non|has|with|without|not|is|show|hide|enable|disable)[-_]|[-_](free|less|open|closed|enabled|disabled|off|on)$")
SURE, MARKED, MIXED, MIXED_HEADER, GOOD = -9.0, -8.0, -6.0, -1.0, 1.0
#: What an element is worth where the page has an article elsewhere; the least and the most that evidence adds up to.
OUTSIDE, LEAST, MOST = -3.0, -9.0, 5.0
#: Weights of the classifier of blocks.
WEIGHTS = {"bias": -2.8, "words": 3.5, "sentence": 0.8, "text_tag": 0.8, "links": -3.0, "heading": 0.6, "title": 2.0}
ENOUGH_WORDS = 40
#: Smoothness: block and element, neighbours, blocks of one element, element and element around it; what is left of it across a boundary.
HELD, NEAR, SIBLING, AROUND, ACROSS = 6.0, 0.4, 0.8, 1.0, 0.2
#: What one open tag of a kind closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

class Element:
    """An open tag: its place in the tree, and its own evidence."""

    __slots__ = ("tag", "above", "evidence", "role", "blocks", "prose", "title")

    def __init__(self, tag: str, above: int, evidence: float, hidden: bool) -> None:
        self.tag, self.above, self.evidence = tag, above, evidence
        self.role = "hidden" if hidden else ""
        self.blocks, self.prose, self.title = 0, 0, False


class Block:
    __slots__ = ("text", "words", "links", "tag", "element")


def name_evidence(names: list[str]) -> float:
    """What the class names, id and role of an element say for or against it."""
    found, good = 0.0, False
    for name in names:
        if TELLING.search(name.lower()):
            continue
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        marks = MARKS.intersection(parts)
        if not marks:
            good = good or not GOOD_MARKS.isdisjoint(parts)
        elif SURE_MARKS & marks:
            found = min(found, SURE)
        elif GOOD_MARKS.isdisjoint(parts):
            found = min(found, MARKED)
        else:
            found = min(found, MIXED_HEADER if marks == {"header"} else MIXED)
    return found if found else GOOD * good


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, 0.0, False)]
        self.stack: list[tuple[str, int]] = []  # tag, place among the elements
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0
        self.silent: list[str] = []

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            b = Block()
            b.text, b.words = " ".join(words), len(words)
            b.links = min(1.0, self.linked / max(1, len(b.text)))
            b.tag = next((t for t, _ in reversed(self.stack) if t in BLOCK_TAGS), "")
            b.element = self.stack[-1][1] if self.stack else 0
            self.blocks.append(b)
        self.parts, self.linked = [], 0

    def close_to(self, i: int) -> None:
        self.flush()
        if any(s[0] == "a" for s in self.stack[i:]):
            self.in_link = 0
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            if tag not in ("title", "option"):
                self.silent.append(tag)
            elif not self.silent:
                self.silent.append(tag)
            return
        if self.silent and tag not in ("body", "article", "main"):
            return
        if self.silent:
            self.silent.clear()
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in VOID:
            return
        if tag == "a":
            self.in_link = 1
            return
        a = dict(attrs)
        role = str(a.get("role") or "").strip().lower()
        evidence = 0.0
        if tag not in ("html", "body"):
            evidence = name_evidence([*str(a.get("class") or "").split(), *str(a.get("id") or "").split()])
            if tag in ("article", "main") and evidence > SURE:
                evidence = 0.0  # only a comment or an advert is an article that is none
        evidence = min(evidence, ROLES.get(role, 0.0)) if evidence < 0 else ROLES.get(role, evidence)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in re.sub(r"\s", "", str(a.get("style") or "").lower())
        if tag not in BLOCK_TAGS:
            if not (evidence < 0 or hidden):
                return  # other inline tags change nothing
            self.flush()
        else:
            self.flush()
            self.in_link = 0
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i][0]
                if open_tag == "p" or open_tag in CLOSED_BY.get(tag, ()) or (tag in HEADINGS and open_tag in HEADINGS):
                    self.close_to(i)
                    break
                if open_tag in BLOCK_TAGS:
                    break
        own = ELEMENTS.get(tag, 0.0)
        self.elements.append(Element(tag, self.stack[-1][1] if self.stack else 0, min(own, evidence) if min(own, evidence) < 0 else max(own, evidence), hidden))
        self.stack.append((tag, len(self.elements) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
                return
            if tag not in BLOCK_TAGS:
                return
            if tag in self.silent:
                return
            self.silent.clear() if tag in ("body", "html") else None
            if self.silent:
                return
        if tag == "a":
            self.in_link = 0
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close_to(i)
                return
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks, reader.elements


def log_odds(b: Block) -> float:
    """The classifier's log-odds that a block is content, from its text and tag."""
    x = WEIGHTS["bias"] + WEIGHTS["words"] * min(1.0, math.log1p(b.words) / math.log1p(ENOUGH_WORDS)) + WEIGHTS["links"] * b.links
    x += WEIGHTS["text_tag"] * (b.tag in TEXT_TAGS) + WEIGHTS["sentence"] * (b.text[-1] in ".!?…\"'”»")
    return x + WEIGHTS["heading"] * (b.tag in HEADINGS) + WEIGHTS["title"] * (b.tag == "h1")


def weigh(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[int]]:
    """The evidence of every element, with that of the elements around it; for every block the element that holds it."""
    prose = [0] * len(elements)
    for b in blocks:
        prose[b.element] += b.words if b.links < 0.5 else 0
        if b.tag == "h1":
            elements[b.element].title = True
    article = [e.tag in ("article", "main") and e.evidence > 0 for e in elements]
    holds = list(article)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        prose[e.above] += prose[i]
        holds[e.above] = holds[e.above] or holds[i]
        elements[e.above].title = elements[e.above].title or e.title
    total = max(1, prose[0])
    outermost = [False] * len(elements)
    sections = 0
    for i, e in enumerate(elements[1:], 1):
        outermost[i] = outermost[e.above] or article[i]
        if outermost[i] and not outermost[e.above]:
            sections += prose[i]
    evidence = [OUTSIDE if sections >= 0.3 * total else 0.0] + [0.0] * (len(elements) - 1)
    for i, e in enumerate(elements[1:], 1):
        own, share = e.evidence, prose[i] / total
        if own < 0 and e.tag not in ("nav", "footer", "aside", "menu"):
            if share >= 0.9 and own > SURE or share >= 0.5 and (e.title or holds[i]):
                own = 0.0  # it is the page, whatever it is called
            elif share > 0.5 and own > SURE:
                own *= 2 * (1 - share)
        around = evidence[e.above]
        if own >= 5:  # an article answers for itself, unless it stands in what is none
            around = 0.0 if around >= OUTSIDE else around
        evidence[i] = LEAST if e.role == "hidden" else max(LEAST, min(MOST, around + own))
    held = []
    for b in blocks:
        i = b.element
        while i and elements[i].tag in PLAIN_TAGS and elements[i].evidence == 0 and not elements[i].role:
            i = elements[i].above
        if b.tag in HEADINGS:
            # The heading in the header of an article, or of a post, is the article's.
            j = i
            while j and elements[j].tag not in ("header", "hgroup") and elements[j].evidence != MIXED_HEADER and elements[j].evidence == 0 and elements[j].tag not in ("article", "main"):
                j = elements[j].above
            if j and (elements[j].tag == "hgroup" or elements[j].evidence == MIXED_HEADER or elements[j].tag == "header" and evidence[elements[j].above] > 0):
                i = elements[j].above
                while i and elements[i].tag in ("header", "hgroup") and evidence[elements[i].above] > 0:
                    i = elements[i].above
        held.append(i)
    return evidence, held


def minimum_cut(n: int, costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which of n nodes stay with the source. costs: a node's capacities from the source and to the sink; edges: a, b, capacity both ways.

    Blocking flows in layers, without recursion; whole-number capacities.
    """
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, (keep, drop) in enumerate(costs):
        # What passes straight through needs no search.
        through = min(keep, drop)
        if keep > through:
            join(source, i, keep - through, 0)
        if drop > through:
            join(i, sink, drop - through, 0)
    for a, b, c in edges:
        if c > 0:
            join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
                continue
            path.append(e)
            a = to[e]


def graph(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The log-odds of all nodes, the blocks first, and the smoothness edges between them."""
    evidence, held = weigh(blocks, elements)
    count = [0] * len(elements)
    for i in held:
        count[i] += 1
    # Elements that hold blocks, and those around them, are nodes.
    used = [n > 0 for n in count]
    for i in range(len(elements) - 1, 0, -1):
        used[elements[i].above] = used[elements[i].above] or used[i]
    node, odds, edges = {}, [log_odds(b) for b in blocks], []
    for i, e in enumerate(elements):
        if used[i]:
            node[i] = len(odds)
            odds.append(evidence[i] * count[i])
            if i:
                edges.append((node[e.above], node[i], AROUND * (1.0 if e.evidence == 0 and not e.role else ACROSS)))
    last: dict[int, int] = {}
    for k, i in enumerate(held):
        edges.append((k, node[i], HELD))
        if k:
            edges.append((k - 1, k, NEAR * (1.0 if evidence[held[k - 1]] == evidence[i] else ACROSS)))
        if i in last:
            edges.append((last[i], k, SIBLING))
        last[i] = k
    return odds, edges


def label(blocks: list[Block], elements: list[Element]) -> list[bool]:
    """Which blocks are content."""
    scale = 1000
    odds, edges = graph(blocks, elements)
    # Calling a node content costs what speaks against it, and the other way round.
    costs = [(round(scale * max(x, 0.0)), round(scale * max(-x, 0.0))) for x in odds]
    return minimum_cut(len(odds), costs, [(a, b, round(scale * w)) for a, b, w in edges])[: len(blocks)]


def main_text(html: str | None) -> str:
    blocks, elements = blocks_of(html or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks, elements), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    require(pages, "page_id", "url", "html")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(task, "page_id long, url string, text string, n_chars long")
