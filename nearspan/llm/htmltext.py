"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Every text block has a root-to-leaf tag path
(tag names with their class and id). For each path of a page the text outside links and its
punctuation are added up and divided by the number of its blocks; both ratios count up to that
of prose, so that no text is dropped because another one is longer, and are smoothed
over the paths at an edit distance of one or two (Gaussian weights; to exchange a tag costs
one, to add or leave out a tag two) and fused by their
geometric mean. What the tags on a path are called is one factor more: PENALTY for each one
that names something beside the article (navigation, adverts, comments and so on), BONUS for
one that names an article. A page's common penalties do not count (a form or an element with
such a word may hold everything). Paths with at least THRESHOLD of the page's mean score are content
nodes; the mean is weighted by length and by that factor.

The article is the text of the content nodes, and of what stands among them: a content node
stands for the outermost element around it that is called an article, or else for its parent
(but never for the whole body), and the other blocks of that element are kept unless more of
their tags are penalised, or they are mostly links. So headings, captions and table cells stay
with their article, and only ratios decide which articles there are.

Script, style, templates, frames, text areas, drawings and hidden parts are no text at all;
menus, footers and selections take part in the ratios but are never content.
Inline tags (labels and buttons too) do not end a block; character references are decoded;
white space inside a block is one blank, blocks are joined by one blank.

Defined results: a null or empty page, or one without text, gives ""; unclosed and misplaced
tags are closed as browsers do in the common cases (a frame or text area without an end tag
hides nothing); paths with equal scores are content nodes together; pages are independent, so
repeats give equal texts; time is linear in the page, however deep it nests; an empty table
gives no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, with_fields

#: How HTML's tags behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
#: Raw parts that go on to the page's end where no end tag follows.
TO_THE_END = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html".split())
#: Names of what stands beside an article, by tag, role, and words of class and id.
OTHER_TAGS = frozenset("aside form dialog fieldset".split())
#: Elements that hold no article by their definition.
NEVER = frozenset("nav menu footer select".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations trending pagination pager search copyright disclaimer".split()
)
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Share of the page's mean score that a content path has.
THRESHOLD = 0.3
#: Text and punctuation a block from which a path counts as prose whatever its length.
PROSE, MARKS = 160.0, 4.0
#: Factors of what the tags on a path are called.
PENALTY, BONUS = 0.05, 2.0
#: Gaussian weights of paths at an edit distance of one and two.
NEAR, FAR = math.exp(-0.5), math.exp(-2.0)


def _words(value: str) -> set[str]:
    return set(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", " ").replace("-", " ").split())


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or "display:none" in own.get("style", "").replace(" ", "").lower()


def _other(tag: str, own: dict[str, str], named: set[str], articles: int) -> bool:
    """Whether an element is called something beside the article."""
    if tag in OTHER_TAGS or tag in NEVER or own.get("role", "").lower() in OTHER_ROLES:
        return True
    if tag == "header":
        return not articles
    return tag not in ("html", "body", "main", "article") and bool(named & OTHER_WORDS)


@dataclass
class Element:
    """An open element: its path (a node of the page's tree of paths) and what it is called."""

    tag: str
    number: int
    path: int
    penalties: int  # on the way from the root
    article: int  # number of the outermost element called an article, with equal penalties; or -1
    hidden: bool
    named: bool
    never: bool


@dataclass
class Block:
    """One text block with the element that it stands in."""

    element: Element
    pieces: list[str] = field(default_factory=list)
    link: int = 0
    text: str = ""


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)  # of elements by number
    whole: set[int] = field(default_factory=set)  # html and body elements
    penalties: list[int] = field(default_factory=list)  # of elements by number
    above: list[int] = field(default_factory=lambda: [0])  # of paths; path 0 is the root


def blocks(page: str) -> Page:
    """The text blocks outside of hidden parts, in page order."""
    out = Page()
    root = Element("", -1, 0, 0, -1, False, False, False)
    stack: list[Element] = []
    tags: Counter[str] = Counter()  # open elements by tag
    paths: dict[tuple[int, str], int] = {}
    current: Block | None = None
    at, hidden, links, articles = 0, 0, 0, 0
    endless: set[str] = set()  # raw tags without an end tag further on

    def text(a: int, b: int) -> None:
        nonlocal current
        if a >= b or hidden:
            return
        piece = page[a:b]
        if current is None:
            if not piece.strip():
                return
            current = Block(stack[-1] if stack else root)
            out.blocks.append(current)
        current.pieces.append(piece)
        if links:
            current.link += len(piece)

    def pop() -> None:
        nonlocal hidden, articles, current
        e = stack.pop()
        tags[e.tag] -= 1
        hidden -= e.hidden
        articles -= e.tag in ("article", "main")
        current = None

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        text(at, m.start())
        at = m.end()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            # Its content is no markup: go on behind the end tag.
            if not close and not rest.endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            links = max(0, links + (-1 if close else 1)) if tag == "a" else links
            continue
        if tag in VOID:
            if tag in ("br", "hr") and current is not None:
                current.pieces.append(" ")
            if tag == "hr":
                current = None
            continue
        links = 0
        current = None
        if close:
            if tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in ENDS_PARAGRAPH and tags["p"]:
            while stack[-1].tag != "p":
                pop()
            pop()
        if any(tags[t] for t in SIBLINGS.get(tag, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in SCOPE:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    while len(stack) > i:
                        pop()
                    break
        if tag == "body" and stack and stack[-1].tag == "head":
            pop()
        own = {k.lower(): next((v for v in g if v), "") for k, *g in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        named = _words(own.get("class", "")) | _words(own.get("id", ""))
        up = stack[-1] if stack else root
        label = ".".join([tag, *sorted(named)])
        path = paths.setdefault((up.path, label), len(paths) + 1)
        if path == len(out.above):
            out.above.append(up.path)
        other = _other(tag, own, named, articles)
        penalties, number = up.penalties + other, len(out.parents)
        called = tag in ("article", "main") or bool(named & ARTICLE_WORDS) and not other
        article = number if called and (other or up.article < 0) else -1 if other else up.article
        e = Element(tag, number, path, penalties, article, _hidden(own), up.named or called, up.never or tag in NEVER)
        out.parents.append(up.number)
        out.penalties.append(penalties)
        if tag in ("html", "body"):
            out.whole.add(number)
            e.article = -1
        stack.append(e)
        tags[tag] += 1
        hidden += e.hidden
        articles += tag in ("article", "main")
        if rest.endswith("/"):
            pop()
    text(at, len(page))
    return out


def clean(pieces: list[str]) -> str:
    return " ".join(references.unescape("".join(pieces)).split())


def ratios(page: Page) -> dict[int, float]:
    """The score of each path that has text, before what its tags are called: the fused,
    smoothed ratios. In the tree of paths, siblings are at a distance of one; parent, children
    and children of the parent's siblings of two. All sums are over the tree, so the work is
    linear in its size."""
    n = len(page.above)
    sums: dict[int, list[float]] = {}
    for b in page.blocks:
        s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0])
        s[0] += max(len(b.text) - 0.9 * b.link, 0.0)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    own = np.zeros((n, 3))  # 1 for a path with text, its two ratios
    for path, (length, marks, visits) in sums.items():
        # Prose is prose from some length on: a longer block must not outweigh it.
        own[path] = 1.0, min(length / visits, PROSE), min(marks / visits, MARKS)
    above = np.array(page.above)
    children, grand = np.zeros((n, 3)), np.zeros((n, 3))
    np.add.at(children, above[1:], own[1:])
    np.add.at(grand, above[1:], children[1:])
    inner = np.arange(n)[:, None] > 0  # the root has neither siblings nor parent
    second = inner & (above[:, None] > 0)
    near = np.where(inner, children[above] - own, 0)
    far = children + np.where(inner, own[above], 0) + np.where(second, grand[above[above]] - children[above], 0)
    mixed = own + NEAR * near + FAR * far
    length, marks = (np.maximum(mixed[:, i], 0) / np.maximum(mixed[:, 0], 1e-9) for i in (1, 2))
    fused = np.sqrt(length * (1 + marks))
    return {v: float(fused[v]) for v in sums}


def extract(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    read = blocks(page)
    for b in read.blocks:
        b.text = clean(b.pieces)
    read.blocks = [b for b in read.blocks if b.text]
    if all(b.element.never for b in read.blocks):
        return ""
    fused = ratios(read)
    least = min(b.element.penalties for b in read.blocks if not b.element.never)
    factor = {b.element.path: PENALTY ** min(max(b.element.penalties - least, 0), 200) * (BONUS if b.element.named else 1.0) for b in read.blocks}
    score = {path: fused[path] * x for path, x in factor.items()}
    weights = [len(b.text) * factor[b.element.path] for b in read.blocks]
    mean = sum(w * score[b.element.path] for w, b in zip(weights, read.blocks, strict=True)) / sum(weights)
    content = [score[b.element.path] >= THRESHOLD * mean and not b.element.never for b in read.blocks]
    # The elements that content nodes stand for, and what stands among them.
    chosen = set()
    for b, good in zip(read.blocks, content, strict=True):
        if good and b.element.number >= 0:
            e = b.element.article if b.element.article >= 0 else read.parents[b.element.number]
            if e >= 0 and e not in read.whole:
                chosen.add(e)
    around = []  # penalties of the innermost chosen element around each element
    for number, parent in enumerate(read.parents):
        around.append(read.penalties[number] if number in chosen else around[parent] if parent >= 0 else -1)
    among = [b.element.number >= 0 and around[b.element.number] == b.element.penalties and b.link <= 0.5 * len(b.text) for b in read.blocks]
    return " ".join(b.text for b, good, near in zip(read.blocks, content, among, strict=True) if good or near)


def main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of `html` (an existing column of that name is replaced) and
    n_chars."""
    small_batches(pages.sparkSession)
    taken = (text.lower(), "n_chars")
    kept = [c for c in pages.columns if c.lower() not in taken and c != html]
    schema = with_fields(pages.select(*kept), f"`{text}` string, n_chars long")
    source = pages.select(*kept, F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(len(kept)).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
