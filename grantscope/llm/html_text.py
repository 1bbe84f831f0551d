"""Main text of web pages by tag-path ratios.

A page is read into blocks of text in page order, each with its path of tags from
the root.  Per path, the characters of text, those of links and the punctuation
marks are summed over the blocks; the path's ratio is text per block, raised by
punctuation and lowered by links.  Ratios are smoothed over neighbouring blocks,
fused with the share of text that the path's container holds, and a threshold on
the fused score selects the content paths.

Names of classes and ids are a feature of the score: what they call a menu, an
advert or a comment weighs little, wherever it stands, and is left out if the page has
other text.  Only elements that by their own tag, role or hidden state hold no article (navigation,
headers and footers of the page, asides, scripts, styles, forms that do not hold the page) are left out before paths are counted.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W

#: A quoted value ends its tag's bracket only if a quote closes it: one with ``>`` inside within 4096 characters, before a space or the tag's end.
VALUE = r"""\"[^\">]*+\"|'[^'>]*+'|\"[^\"]{0,4096}+\"(?=[\s/>]|\Z)|'[^']{0,4096}+'(?=[\s/>]|\Z)"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|{VALUE})*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTR = re.compile(r"(?<![^\s/\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|[\"']?([^\s>\"']++))")
RAW = frozenset("script style noscript template iframe object noembed noframes textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("nav footer aside script style noscript template iframe object svg head button select option textarea input label fieldset menu dialog canvas audio video map datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the first kind ends where one of the second begins.
CLOSES = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]),
}
SCOPE = frozenset("html body div section article main table td th ul ol dl blockquote aside nav footer header form figure details".split())
NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent
    cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
    pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup
    skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar tracking widget widgets""".split()
)
#: Those that hold for an article as well.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words of elements that never are an article, however much they hold; what others name alone may be one, if the page has no other.
NEVER = COMMENTS | frozenset(
    """ad ads advert adverts advertisement advertisements adsense breadcrumb breadcrumbs byline consent cookie cookies copyright footer gdpr login menu nav navbar
    navigation newsletter pager pagination paywall signup sponsor sponsored subscribe subscription""".split()
)
#: Words that say nothing of what an element holds; a name made of these and of NAMES alone is a strong one.
NEUTRAL = frozenset(
    """area article bar block blog body bottom box btn button buttons center col column container content count custom desktop entry fixed global group head
    heading holder icon icons inner item items left link links list main mobile module news outer page panel post posts primary right row secondary section
    single site small sticky story text title top view wrap wrapper""".split()
)
#: What a path weighs by the names on it: none of NAMES, one beside other words, one by itself.
PLAIN, WEAK, STRONG = 1.0, 0.5, 0.05
#: Text by a strong name counts as the article if what stands elsewhere is less than this share of it, and it has so many characters and a block of so many.
SHARE, LEAST_TEXT, LEAST_BLOCK = 0.25, 200, 80
#: A form with this share of a page's text holds the page.
FORM_SHARE = 0.5
LISTS = frozenset("ul ol dl table blockquote pre".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(["article", "main"])
PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
HUMP = re.compile(r"([a-z])([A-Z])")
STATES = frozenset("with has have no is without".split())
HEADING = re.compile(r"h[1-6](?:\.|$)")
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    """Text with the number of its path, of the path's container, and what is known of both."""

    path: int
    parent: int
    text: str
    link: int = 0
    inside: bool = False
    weight: float = PLAIN
    heading: bool = False
    never: bool = False
    form: int = 0
    within: int = 0  # the element around its own
    holder: int = -1  # the element around the list that it is in


@dataclass(slots=True)
class Node:
    """An open element; all but the tag hold for what it contains."""

    tag: str
    path: int = 0
    cut: bool = False
    content: bool = False
    link: bool = False
    weight: float = PLAIN
    never: bool = False
    form: int = 0
    element: int = 0
    within: int = 0
    holder: int = -1


@dataclass
class Reader:
    """Builds blocks from tokens; unclosed and misnested tags are tolerated.

    Paths are numbered as they come up, by their container and last element, so a step
    costs the same at any depth; places of open elements are kept by tag.
    """

    stack: list[Node] = field(default_factory=lambda: [Node("")])
    places: dict[str, list[int]] = field(default_factory=dict)
    scopes: list[int] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    above: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    at: Node | None = None
    forms: int = 0
    elements: int = 0

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            link, own = len(SPACES.sub(" ", "".join(self.linked)).strip()), self.at
            heading = HEADING.match(self.names[own.path]) is not None
            self.blocks.append(Block(own.path, self.above[own.path], text, link, own.content, own.weight, heading, own.never, own.form, own.within, own.holder))
        self.parts, self.linked = [], []

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.cut:
            return
        raw = entities.unescape(raw)
        if not self.parts:
            self.at = top
        self.parts.append(raw)
        if top.link:
            self.linked.append(raw)

    def open(self, tag: str, attrs: str, closed: bool) -> None:
        if tag in ("br", "wbr"):
            if tag == "br" and self.parts:
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag != "hr":
                self._imply(tag)
        if tag in VOID or closed and tag not in BLOCK and tag not in RAW:
            return
        new, name = node(tag, attrs, self.stack[-1])
        if tag == "form" and not new.form:
            self.forms += 1
            new.form = self.forms
        if tag in LISTS and new.holder < 0:
            new.holder = new.element
        if tag in BLOCK:
            self.elements += 1
            new.within, new.element = new.element, self.elements
            key = (new.path, name)
            if key not in self.paths:
                self.paths[key] = len(self.above)
                self.above.append(new.path)
                self.names.append(name)
            new.path = self.paths[key]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(new)

    def _cut_back(self, n: int) -> None:
        """Closes all elements from place ``n`` of the stack."""
        for x in reversed(self.stack[n:]):
            self.places[x.tag].pop()
            if x.tag in SCOPE:
                self.scopes.pop()
        del self.stack[n:]

    def _imply(self, tag: str) -> None:
        """Closes the nearest element that ends where ``tag`` begins, if no scope lies between."""
        open_ = [self.places[own][-1] for own, ends in CLOSES.items() if tag in ends and self.places.get(own)]
        if open_ and max(open_) >= (self.scopes[-1] if self.scopes else 0):
            self._cut_back(max(open_))

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        own = self.places.get(tag)
        if own and (tag in SCOPE or own[-1] > (self.scopes[-1] if self.scopes else 0)):
            self._cut_back(own[-1])


def label_weight(labels: str, names: frozenset[str] = NAMES) -> float:
    """What an element weighs by the words of its classes and its id, if one of them is in ``names``."""
    weight = PLAIN
    for label in labels.split():
        words = re.findall(r"[a-z]+", HUMP.sub(r"\1-\2", label).lower())
        if words and words[0] not in STATES and names.intersection(words):
            weight = min(weight, STRONG if NAMES.issuperset(set(words) - NEUTRAL) else WEAK)
    return weight


def hides(attrs: str, found: dict[str, str]) -> bool:
    """Whether an element is hidden, by an attribute of its own; words inside values say nothing."""
    if "hidden" in attrs.lower() and ("hidden" in found or "hidden" in ATTR.sub(" ", attrs).lower().strip("/").split()):
        return True
    return "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true"


def node(tag: str, attrs: str, above: Node) -> tuple[Node, str]:
    """An element below another, and its name in a path: its tag and classes."""
    found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTR.findall(attrs)} if "=" in attrs else {}
    marked = tag in CONTENT or found.get("role") == "main" or found.get("itemprop") == "articleBody"
    names = frozenset() if tag in ("html", "body") else COMMENTS if marked and tag != "div" else NAMES
    labels = f"{found.get('class', '')} {found.get('id', '')}"
    weight = label_weight(labels, names)
    never = above.never or weight == STRONG and label_weight(labels, names & NEVER) == STRONG
    cut = above.cut or tag in CUT or hides(attrs, found) or found.get("role") in ROLES or tag == "header" and not above.content
    name = ".".join([tag, *sorted(set(found.get("class", "").split()))])
    return Node(tag, above.path, cut, above.content or marked, above.link or tag == "a", min(weight, above.weight), never, above.form, above.element, above.within, above.holder), name


def blocks_of(page: str) -> list[Block]:
    reader, at = Reader(), 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            token = m.group()
            if not token.startswith(("<!", "<?")):
                reader.text(token)
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            reader.close(tag)
            continue
        attrs = (m["attrs"] if m["tag"] else m["attrs2"]) or ""
        reader.open(tag, attrs, attrs.endswith("/"))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            reader.close(tag)
    reader.flush()
    return reader.blocks


def ratios(blocks: list[Block]) -> np.ndarray:
    """A score per block: the path's ratio, smoothed over neighbours, fused with its container's share, weighed by names.

    A path that a name speaks against gains nothing from its neighbours.
    """
    path, parent = np.array([b.path for b in blocks]), np.array([b.parent for b in blocks])
    size, link = np.array([float(len(b.text)) for b in blocks]), np.array([float(b.link) for b in blocks])
    punct, weight = np.array([float(len(PUNCT.findall(b.text))) for b in blocks]), np.array([b.weight for b in blocks])
    n, text, links, marks = (np.bincount(path, x)[path] for x in (np.ones(len(blocks)), size, link, punct))
    raw = (text - links) / n * np.log2(2 + marks / n) * (1 - links / text)
    kernel = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
    smooth = np.convolve(np.pad(raw * weight, 2), kernel, "valid") / np.convolve(np.pad(np.ones(len(raw)), 2), kernel, "valid")
    share = np.bincount(parent, size * weight)[parent] / max(1.0, float((size * weight).sum()))
    share = np.where([b.inside for b in blocks], 1.0, share)
    return weight * np.sqrt(np.where(weight < PLAIN, raw, np.maximum(raw, 0.25 * smooth)) * (0.1 + share))


def told_apart(blocks: list[Block]) -> list[Block]:
    """The blocks without those of forms, but for a form that holds most of the page; strong names are weak ones where they name most of it."""
    total, forms = 0, {}
    for b in blocks:
        own = len(b.text) - b.link
        total += own
        forms[b.form] = forms.get(b.form, 0) + own
    blocks = [b for b in blocks if not b.form or forms[b.form] >= max(FORM_SHARE * total, LEAST_TEXT)]
    named = [b for b in blocks if b.weight == STRONG and not b.never]
    held, other = sum(len(b.text) - b.link for b in named), sum(len(b.text) - b.link for b in blocks if b.weight > STRONG)
    if held >= LEAST_TEXT and other < SHARE * held and max(len(b.text) - b.link for b in named) >= LEAST_BLOCK:
        for b in named:
            b.weight = WEAK
    return blocks


def main_text(page: str | None) -> str:
    """Blocks of the content paths in page order, joined by two line feeds; empty if there are none.

    A path is content if its best score reaches a share of the page's best: a tenth
    where the page marks its article (``article``, ``main``), else a third.  A
    heading goes with content that follows it in the same container, and a list, table or quotation with content
    before it in the container that holds it.
    """
    if not page:
        return ""
    blocks = told_apart(blocks_of(page))
    if not blocks:
        return ""
    best: dict[int, float] = {}
    for b, x in zip(blocks, ratios(blocks).tolist(), strict=True):
        best[b.path] = max(best.get(b.path, 0.0), x)
    top = max(best.values())
    chosen = {b.path for b in blocks if best[b.path] > 0 and best[b.path] >= top * (0.1 if b.inside else 0.35)}
    keep = [b.path in chosen and b.weight > STRONG and b.link < 0.9 * len(b.text) for b in blocks]
    text: dict[int, int] = {}
    links: dict[int, int] = {}
    for b in blocks:
        text[b.path], links[b.path] = text.get(b.path, 0) + len(b.text), links.get(b.path, 0) + b.link
    open_ = set()
    for i, b in enumerate(blocks):
        if keep[i] and b.holder < 0:
            open_.add(b.within)
        elif b.holder in open_ and b.weight == PLAIN and 2 * links[b.path] < text[b.path]:
            keep[i] = True
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i].heading and blocks[i].parent == blocks[i + 1].parent and blocks[i].weight == PLAIN and keep[i + 1]:
            keep[i] = True
        elif blocks[i].heading and blocks[i].within == blocks[i + 1].holder and blocks[i].weight == PLAIN and keep[i + 1]:
            keep[i] = True
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, ``text`` and ``n_chars`` (its code points).

    The whole HTML is read, in time and memory in proportion to it at any depth of
    elements.  Null or empty HTML, and a page without content, gives an empty text.  Equal
    rows give equal rows; paths of equal score are all chosen; other columns are ignored;
    an empty table gives an empty result.
    """
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(2))
            for i, j in W.blocks(offsets):
                texts = [main_text(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars"])

    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
