"""Main text of web pages: site templates, page furniture and markup go, the article stays.

Each page is parsed into its elements. An element's subtree has a hash of its tags, classes and text. Spark counts for
every host on how many different pages a subtree occurs; one that recurs on many pages of its host is template and is
deleted, along with elements whose tag, role, class or id says that they are furniture. Of what is left, the article
(or the main part, or else the body) is the text.

Paragraphs, headings, lists and tables themselves are never taken for template inside an article: they are what is
asked for, even where a host shows one passage on many pages. A box that holds some (a division or section) is template
there if it stands on nearly all pages of its host, unless the article would have no text without it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: A subtree is template if it is on so many pages of its host and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: The same for a box with prose inside an article.
BOX_SHARE = 0.7

# Fixed values of HTML: elements without an end tag, elements whose content is not markup, and end tags that may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split()) | frozenset(["p"])
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
INSIDE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
# Fixed values of this operator: what is page furniture by tag, role, class or id.
FURNITURE = frozenset("aside button canvas datalist dialog embed footer form head header iframe input menu nav noembed noframes noscript object script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = re.compile(
    r"^(ad|ads|advert\w*|adslot|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar\w*|aside|widget\w*|cookie\w*|consent\w*|gdpr|notice\w*|popup|modal|overlay|newsletter\w*|subscribe|subscription|signup|login|search\w*|form|comment\w*|disqus\w*|replies|respond|share|sharing|social\w*|related\w*|recommend\w*|pagination|pager|toc|skip|copyright|legal|disclaimer)$"
)
#: Parts that a compound name of furniture may have beside those of NAMES; any other part tells of content (related-work).
BESIDE = re.compile(r"^(area|bar|block|bottom|box|btn|button|buttons|col|column|container|content|desktop|fixed|form|global|group|icon|icons|inner|item|items|left|link|links|list|main|mobile|module|outer|overlay|page|panel|popup|posts|primary|right|secondary|section|site|slot|sticky|strip|top|unit|wrap|wrapper|\d+(x\d+)?)$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong span a body html ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td".split())

# A quote opens a string only where a value begins, and only if it is closed; elsewhere it is a character as any other.
_tokens = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)?)*+)(?:>|$)", re.S)
_attributes = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_space = re.compile(r"\s+")
_words = re.compile(r"[a-z]+")
_raw_ends: dict[str, re.Pattern] = {}


class Element:
    __slots__ = ("furniture", "hash", "looks", "parts", "prose", "tag")

    def __init__(self, tag: str, looks: str = "", furniture: bool = False):
        self.tag, self.looks, self.furniture = tag, looks, furniture
        self.parts: list = []
        self.hash = 0
        self.prose = False


@lru_cache(maxsize=100_000)
def _named(names: str, whole: bool = False) -> bool:
    """Whether any of the names is one of furniture: as a whole, or with parts that are all of NAMES or BESIDE."""
    for word in names.split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        if NAMES.match(word) or not whole and any(map(NAMES.match, parts)) and all(NAMES.match(p) or BESIDE.match(p) for p in parts):
            return True
    return False


def _furniture(tag: str, attributes: str, stack: list[Element]) -> tuple[str, bool]:
    """(class, id and role; whether they or the tag mean furniture). stack: the elements that it stands in."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "", tag in FURNITURE
    found = {}
    for name, a, b, c in _attributes.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    own_class, own_id = found.get("class", "").lower(), found.get("id", "").lower()
    own = f"{own_class} {own_id}"
    named = _named(own) and tag not in ("article", "main", "body", "html")
    if named and tag not in BLOCK and (tag == "code" or any(e.tag in ("pre", "code") for e in stack)):
        named = False  # a token of a listing
    if named and tag in PROSE and any(e.tag in ("article", "main") for e in stack):
        # Ids come from the words of a heading; a class counts only as a whole, and not a heading's.
        named = tag not in HEADINGS and _named(own_class, True)
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    role = found.get("role", "").lower()
    off = tag in FURNITURE or hidden or role in ROLES or named
    return f"{own.strip()} {role}".strip(), off


def parse(page: str) -> Element:
    """The page's elements as a tree; unclosed and misplaced tags are mended much as browsers do."""
    root = Element("html")
    stack = [root]
    at, size, match = 0, len(page), _tokens.search
    while at < size:
        m = match(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        begin, end = m.span()
        if begin > at:
            stack[-1].parts.append(page[at:begin])
        at = end
        tag = m.group(2)
        if tag is not None:
            tag = tag.lower()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK:
                        break
            if (ends := ENDED_BY.get(stack[-1].tag)) and tag in ends or tag in INSIDE:
                for i in range(len(stack) - 1, 0, -1):
                    if tag in ENDED_BY.get(stack[i].tag, ()):
                        del stack[i:]
                        break
                    if stack[i].tag in INSIDE.get(tag, ()):
                        break
            looks, off = _furniture(tag, m.group(3), stack)
            e = Element(tag, looks, off)
            stack[-1].parts.append(e)
            if tag in RAW:
                stop = _raw_ends.get(tag) or _raw_ends.setdefault(tag, re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I))
                closing = stop.search(page, at)
                e.parts.append(page[at : closing.start() if closing else size])
                at = closing.end() if closing else size
            elif tag not in VOID and not m.group(3).endswith("/"):
                stack.append(e)
            continue
        tag = m.group(1)
        if tag is not None:
            tag = tag.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # An end tag doesn't reach out of the block it stands in, unless it ends a block itself.
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
    return root


def hashed(root: Element) -> Element:
    """Gives every element the hash of its subtree, from the leaves up (without recursion: pages can be very deep)."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(p for p in e.parts if not isinstance(p, str))
    for e in reversed(order):
        text = "\x01".join(t for p in e.parts if (t := _space.sub(" ", p).strip() if isinstance(p, str) else str(p.hash)))
        e.prose = e.tag in PROSE or any(p.prose for p in e.parts if not isinstance(p, str))
        e.hash = xxhash.xxh64_intdigest(f"{e.tag}\x02{e.looks}\x02{text}") - 2**63
    return root


def candidates(root: Element) -> set[int]:
    """Hashes of the subtrees that may be template: all elements, but inside an article no paragraph, heading, list, table or inline one."""
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or e.tag in ("article", "main")
        if e.tag not in ("html", "body", "article", "main", "br", "head", "meta") and not (inside and e.tag in CONTENT):
            out.add(e.hash)
        todo.extend((p, inside) for p in e.parts if not isinstance(p, str))
    return out


NOTHING: frozenset[int] = frozenset()


def _visible(e: Element, template: frozenset[int], boxes: frozenset[int], inside: bool) -> bool:
    if e.furniture or e.tag in ("html", "body", "article", "main") or inside and e.tag in CONTENT:
        return not e.furniture
    return e.hash not in (boxes if inside and e.prose else template)


def regions(root: Element, template: frozenset[int], boxes: frozenset[int]) -> list[Element]:
    """The outermost articles that are left; else the main parts; else everything."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    todo: list[tuple[Element, bool]] = [(root, False)]
    while todo:
        e, inside = todo.pop()
        if e.tag in found and not inside:
            found[e.tag].append(e)
        inside = inside or e.tag == "article"
        todo.extend((p, inside) for p in reversed(e.parts) if not isinstance(p, str) and _visible(p, template, boxes, inside))
    mains = {id(p) for m in found["main"] for p in _below(m) if p.tag == "main"}
    return found["article"] or [m for m in found["main"] if id(m) not in mains] or [root]


def _below(e: Element) -> Iterator[Element]:
    todo = [p for p in e.parts if not isinstance(p, str)]
    while todo:
        p = todo.pop()
        yield p
        todo.extend(q for q in p.parts if not isinstance(q, str))


def main_text(root: Element, template: frozenset[int] = NOTHING, boxes: frozenset[int] = NOTHING) -> str:
    """Blocks in page order, one a line; white space inside a block is one space. boxes: the template that stands on nearly all pages."""
    text = _main_text(root, template, boxes)
    return text if text or not boxes else _main_text(root, template, NOTHING)


def _main_text(root: Element, template: frozenset[int], boxes: frozenset[int]) -> str:
    blocks: list[str] = []
    for region in regions(root, template, boxes):
        inside = region.tag in ("article", "main")
        current: list[str] = []

        def end(current: list[str] = current) -> None:
            if current:
                if block := _space.sub(" ", html.unescape("".join(current))).strip():
                    blocks.append(block)
                current.clear()

        todo: list = [region]
        while todo:
            p = todo.pop()
            if p is None:
                end()
            elif isinstance(p, str):
                current.append(p)
            elif p is region or _visible(p, template, boxes, inside):
                if p.tag == "br":
                    current.append(" ")
                    continue
                if p.tag in BLOCK:
                    end()
                    todo.append(None)
                todo.extend(reversed(p.parts))
        end()
    return "\n".join(blocks)


def host_of(url: str = "url"):
    """The host in lower case; a page without one has a host of its own that matches nothing else."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, subtree): the candidate subtrees of each page, page being the hash of its html."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b.host, "page": b.page, "subtrees": [sorted(candidates(hashed(parse(h)))) for h in b.html]})

    own = pages.select("host", "page", "html").where("host <> ''")
    return own.mapInPandas(run, "host string, page long, subtrees array<long>")


def templates(pages: DataFrame) -> DataFrame:
    """(host, page, template array<long>, boxes array<long>): of each page that has any, its subtrees that recur on its host, and those of them that do so on nearly all pages.

    A host counts its different pages, so copies of one page don't make its subtrees template.
    """
    found = written(subtrees(pages), "subtrees")
    pages_of = found.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))
    pages_of = written(pages_of, "pages_of")
    totals = pages_of.groupBy("host").agg(F.count("*").alias("total"))
    counted = pages_of.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    recurring = written(counted.join(totals, "host").where(F.col("n") >= F.col("total") * MIN_SHARE).select("host", "subtree", (F.col("n") >= F.col("total") * BOX_SHARE).alias("box")), "templates")
    return pages_of.select("host", "page", F.explode("subtrees").alias("subtree")).join(recurring, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("template"), F.collect_set(F.when(F.col("box"), F.col("subtree"))).alias("boxes"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text. Pages without url or host have only their own furniture
    deleted. Repeated rows give repeated rows; empty pages give none; further columns are ignored.
    """
    own = pages.select("page_id", "url", text_of("html").alias("html")).withColumns({"host": host_of(), "page": F.xxhash64(F.col("html"))})
    template = written(templates(own), "page_templates").select(F.col("host").alias("t_host"), F.col("page").alias("t_page"), "template", "boxes")
    joined = own.join(template, (F.col("host") == F.col("t_host")) & (F.col("page") == F.col("t_page")), "left").select("page_id", "url", "html", "template", "boxes")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for h, t, x in zip(b.html, b.template, b.boxes, strict=True):
                root = parse(h)
                texts.append(main_text(hashed(root), frozenset(map(int, t)), frozenset(map(int, x))) if t is not None and len(t) else main_text(root))
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
