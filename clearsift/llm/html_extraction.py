"""HTML extraction: text-to-tag ratios of lines from parser events, smoothed and clustered into content regions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's block-level elements, which begin and end lines.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold other blocks; where one ends, all that it holds ends too.
CONTAINERS = frozenset("article aside body center div dl fieldset figure footer form header html li main menu nav ol section table td th tr ul head".split())
#: Elements that are never content.
NEVER = frozenset("nav footer menu dialog head script style noscript template iframe svg button select textarea canvas object audio video map".split())
#: Elements that are beside the content, unless they hold nearly all of it.
BESIDE = frozenset(("aside", "form"))
#: Elements of these whose end is waited for, besides CONTAINERS.
HOLDING = CONTAINERS | NEVER | BESIDE
#: Words in class, id or role that mark menus, notices, adverts, comments and other page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe toolbar trending widget".split()
)
#: Words that say nothing by themselves beside one of these; any other word ("related-work") takes a mark back.
NEUTRAL = frozenset(
    "a area bar block body bottom box btn button buttons by class col column container content entry field form global google group head header "
    "inner item items layout left link links list main media module nr outer page panel post posts primary right row secondary section side site "
    "slot small sticky story stories sub text thread title to top unit view with wrap wrapper wide".split()
)
#: Words that mark comments only if what they mark looks like them: several alike children.
IF_REPEATED = frozenset(("discussion", "responses", "reactions", "conversation"))
_FUSED = re.compile(f"(?:{'|'.join(sorted(FURNITURE | NEUTRAL, key=len, reverse=True))})+")
_PIECE = re.compile("|".join(sorted(FURNITURE | NEUTRAL, key=len, reverse=True)))
#: Elements that are content regions by definition.
REGIONS = frozenset(("article", "main"))
_WHOLE = REGIONS | {"html", "body"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAME = re.compile(r"[a-z]+")


@dataclass
class Container:
    """An element that holds others: its name, the one it is in, and whether it is never content or marked as furniture."""

    tag: str
    parent: int
    never: bool = False
    marked: bool = False
    kind: str = ""  # its tag and classes
    doubtful: bool = False  # marked by a word that its children have to bear out


@dataclass
class Line:
    """What stands between the ends of blocks: its text, tags, container, the characters inside links, the links and those to other sites."""

    text: str
    tags: int
    container: int
    linked: int
    links: int = 0
    outside: int = 0


def is_marked(name: str) -> bool:
    """Whether a class, id or role is that of furniture: one of its words is, and no other word says something else."""
    words = _NAME.findall(name.lower())
    words = [p for w in words for p in ([w] if w in FURNITURE or w in NEUTRAL or not _FUSED.fullmatch(w) else _PIECE.findall(w))]
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in NEUTRAL for w in words)


class LineReader(HTMLParser):
    """Turns parser events into lines and the containers they are in; container 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers = [Container("", -1)]
        self.open = [0]
        self.names: Counter[str] = Counter()  # of the open containers
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.begun = self.outside = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append(Line(text, self.tags, self.open[-1], self.linked, self.begun, self.outside))
        self.parts, self.tags, self.linked, self.begun, self.outside = [], 0, 0, 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if self.names["button"]:  # its end is missing: a button holds no blocks
                self.handle_endtag("button")
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links += 1
            self.begun += 1
            self.outside += any(k == "href" and re.match(r"\s*(?:[a-z]+:)?//", v or "", re.IGNORECASE) is not None for k, v in attrs)
        if tag in HOLDING and tag not in _VOID:
            names = [n for k, v in attrs if k in ("class", "id", "role") for n in (v or "").split()]
            marked = tag not in _WHOLE and any(map(is_marked, names))
            doubtful = tag not in _WHOLE and any(n.lower() in IF_REPEATED for n in names)
            kind = " ".join([tag, *sorted(n for k, v in attrs if k == "class" for n in (v or "").split())])
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
            page_header = tag == "header" and not any(self.names[x] for x in REGIONS)
            self.containers.append(Container(tag, self.open[-1], tag in NEVER, marked or hidden or page_header or tag in BESIDE, kind, doubtful))
            self.open.append(len(self.containers) - 1)
            self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.links = max(0, self.links - (tag == "a"))
        while self.names[tag]:  # all that is open inside ends, too
            name = self.containers[self.open.pop()].tag
            self.names[name] -= 1
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len("".join(data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers read it

    def close(self) -> None:
        super().close()
        self.end_line()


def furniture(containers: list[Container], lines: list[Line], least: float = 0.1) -> np.ndarray:
    """Which containers are beside the content, by themselves or with what they are in.

    Marks are only hints: where they leave less than `least` of the page's text, and no article or main part with any,
    the mark of the container that holds most of it is taken back, and so on.
    """
    own = np.zeros(len(containers), np.int64)
    for line in lines:
        own[line.container] += len(line.text)
    parent = [c.parent for c in containers]
    alike = Counter((c.parent, c.kind) for c in containers)
    several = {parent for (parent, kind), n in alike.items() if n > 1 and kind != "p"}
    below_several = {containers[i].parent for i in several} | several  # the list itself may stand one level down
    marked = np.array([c.marked or (c.doubtful and i in below_several) for i, c in enumerate(containers)])
    never = np.array([c.never for c in containers])
    for i in range(1, len(containers)):
        never[i] |= never[parent[i]]
    own[never] = 0
    below = own.copy()
    for i in range(len(containers) - 1, 0, -1):
        below[parent[i]] += below[i]
    in_region = np.array([c.tag in REGIONS for c in containers])
    for i in range(1, len(containers)):
        in_region[i] |= in_region[parent[i]]
    while True:
        out = never | marked
        for i in range(1, len(containers)):
            out[i] |= out[parent[i]]
        left = own[~out].sum()
        heavy = np.where(marked, below, 0)
        if not heavy.any() or own[~out & in_region].any() or left >= least * below[0]:
            return out
        marked[int(heavy.argmax())] = False


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the kernel is normalised at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters (2-means on one axis, from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_root(containers: list[Container], lines: list[Line], chosen: np.ndarray, most: float = 0.95) -> int:
    """The innermost container that holds `most` of the chosen lines' text or more."""
    dense = np.zeros(len(containers), np.int64)
    for i in np.flatnonzero(chosen):
        dense[lines[i].container] += len(lines[i].text)
    for i in range(len(containers) - 1, 0, -1):
        dense[containers[i].parent] += dense[i]
    # A container comes after the one it is in, so that the last that holds enough is the innermost.
    return int(np.flatnonzero(dense >= most * dense[0])[-1])


def menus(containers: list[Container], lines: list[Line]) -> np.ndarray:
    """Lines that are menus by their links: several links of the own site in a row, or the short items of a list of such links.

    A paragraph that is one link, references to other sites and lists of longer titles are text.
    """
    of = lambda x: next((i for i in _upward(containers, x.container) if containers[i].tag in ("ul", "ol", "dl", "table")), 0)
    linked = np.array([x.linked > 0.5 * len(x.text.replace(" ", "")) and not x.outside for x in lines])
    out = linked & np.array([x.links > 1 for x in lines])
    lists: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.text and containers[x.container].tag in ("li", "td", "dl"):
            lists.setdefault(of(x), []).append(i)
    for at, items in lists.items():
        if at and len(items) > 2 and linked[items].all() and sum(len(lines[i].text.split()) for i in items) <= 3 * len(items):
            out[items] = True
    return out


def _upward(containers: list[Container], i: int) -> Iterator[int]:
    while i > 0:
        yield i
        i = containers[i].parent


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page; empty for a null or blank page."""
    if not html:
        return ""
    reader = LineReader()
    reader.feed(html)
    reader.close()
    lines, containers = reader.lines, reader.containers
    if not lines:
        return ""
    beside = furniture(containers, lines)[[x.container for x in lines]]
    ratios = np.array([0.0 if out else len(x.text) / max(x.tags, 1) for x, out in zip(lines, beside, strict=True)])
    if not ratios.any():
        return ""
    smoothed = smooth(ratios, sigma)
    cut = threshold(smoothed)
    chosen = (smoothed >= cut) & (ratios > 0)
    if not chosen.any():
        chosen[int(ratios.argmax())] = True
    # Dense lines mark content regions: their articles or main parts if they are in any, else what holds them all.
    region = [i if c.tag in REGIONS else 0 for i, c in enumerate(containers)]
    for i in range(1, len(containers)):
        region[i] = region[i] or region[containers[i].parent]
    articles = {region[lines[i].container] for i in np.flatnonzero(chosen)} - {0}
    root = content_root(containers, lines, chosen)
    inside = [i == root for i in range(len(containers))]
    for i in range(root + 1, len(containers)):
        inside[i] = inside[containers[i].parent] or i == root
    menu = menus(containers, lines) & (smoothed < cut)
    kept = (x.text for x, out, m in zip(lines, beside, menu, strict=True) if x.text and not out and not m and (region[x.container] in articles if articles else inside[x.container]))
    return " ".join(kept)


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """The main text of every whole page: page_id, url, text, n_chars (code points).

    Every line of a page (what stands between the ends of blocks) has a ratio of text to tags; furniture such as
    menus, adverts, forms, notices and comments has none. Ratios are smoothed, lines above the threshold between
    the two clusters mark content regions: articles and main parts, or what holds them all. The blocks of a region are
    kept, short ones too, but for those of the lower cluster that are menus of the own site. Class names are hints: where they
    would leave next to nothing of a page, they are not believed. Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

    A null, blank or textless page gives an empty text. A very long page is read whole, in time in proportion to it. Markup that never ends is read as far as it goes. Nulls in
    page_id and url are passed on; repeated rows are read one by one; an empty table gives an empty result; further
    columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sigma) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
