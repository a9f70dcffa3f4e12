"""Main text of web pages.

The events of the standard library's parser stream into blocks, a block being the text between two
block-level tags, and so a line in the sense of the text-to-tag ratio.  Lines under ``SKIP`` tags or
roles are never content.  The ratio of each other line (characters outside links for each tag) is smoothed by a Gaussian
over neighbouring lines, and a threshold between two means parts dense lines from sparse ones, on every
page.  The dense lines choose the content region: from the page's root, the way goes down to the child
that holds ``SHARE`` of their text, as long as it has several lines; an article or main element counts
``PRIOR`` times.  In the region, whatever its element, dense lines stay; sparse ones do between dense ones, as headings above
them, or where they are blocks of a kind (tag and parent) that holds dense lines too, so the short paragraph of a text stays and
the line of a reader or a list of links below it goes.  Lines that are mostly links are never dense.

A page is parsed in time linear in its length, however deep or unclosed its elements are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: HTML's element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("head title nav header footer aside form script style noscript template iframe svg math button select option textarea menu dialog object canvas audio video".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role attributes that mark regions besides the main text.
ROLES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|sidebar|side|aside|widget|related|recommended|comment|comments|commentlist|disqus|respond|reply|replies|share|sharing|social|cookie|cookies|consent|notice|newsletter|subscribe|signup|login|popup|modal|overlay|complementary|contentinfo|search|copyright|legal|pagination|pager|tags|skip)(?:$|[\s_-])",
    re.I,
)

#: Words that say what a layout has, not what a region is; words of articles that aren't the page's own.
STATE = re.compile(r"(?:has|with|without|no|is|not|hide|show)-")
REPLIES = frozenset("comment comments reply replies ad ads advert advertisement promo related teaser".split())
#: Share of the dense text that a region must hold, and how much more that of an article or main element counts.
SHARE, PRIOR = 0.9, 1.8
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that the next of their kind closes.
NEXT = frozenset(("p", "li", "td", "th", "tr", "dd", "dt", "option"))
#: A tag or comment that the page's end cuts off.
UNFINISHED = re.compile(r"<(?:/?[A-Za-z]|[!?])")


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    skipped: bool
    element: int


class Blocks(HTMLParser):
    """Lines of a page, and its block elements: number 0 is the page, others follow in order of their start tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parent, self.tag = [0], [""]
        self.open: list[tuple[str, bool, int]] = []  # tag, starts a skipped region, element (its own, or the one around)
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag, where in open it is
        self.blocks: list[int] = []  # where in open block elements are
        self.skipped = self.tags = self.links = self.linked = 0
        self.parts: list[str] = []

    def element(self) -> int:
        return self.open[-1][2] if self.open else 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.skipped > 0, self.element()))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, skip, _ = self.open.pop()
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.skipped -= skip
            self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()
            if tag in NEXT and self.blocks and self.open[self.blocks[-1]][0] == tag:
                self.pop(self.blocks[-1])
            if tag == "body" and self.places["head"]:
                self.pop(self.places["head"][0])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        marks = [t for k, v in attrs if k in ("class", "id", "role") and v for t in v.lower().split() if not STATE.match(t)]
        main = tag in MAIN or "main" in marks
        named = not REPLIES.isdisjoint(marks) if main else any(map(ROLES.search, marks)) and tag not in ("html", "body")
        skip = tag in SKIP or named or any(k == "hidden" for k, _ in attrs)
        element = self.element()
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
            self.parent.append(element)
            self.tag.append("main" if main else tag)
            element = len(self.tag) - 1
        self.open.append((tag, skip, element))
        self.skipped += skip
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        at = self.places[tag]
        # an inline end tag closes nothing beyond its block
        if at and not (tag in INLINE and self.blocks and at[-1] < self.blocks[-1]):
            self.pop(at[-1])

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end is one to the end of the page, and isn't searched again."""
        k = super().parse_comment(i, report)
        return k if k >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over neighbours, renormalised at both ends."""
    half = int(3 * sigma)
    if len(x) < 2 or not half:
        return x
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    keep = slice(half, half + len(x))
    return np.convolve(x, kernel)[keep] / np.convolve(np.ones(len(x)), kernel)[keep]


def threshold(x: np.ndarray) -> float:
    """The cut between the two means of x."""
    cut = float(x.mean())
    for _ in range(50):
        low, high = x[x <= cut], x[x > cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def region(parent: list[int], tag: list[str], element: np.ndarray, mass: np.ndarray) -> tuple[int, int]:
    """The element that the lines' mass chooses, and the last element within it."""
    n = len(parent)
    held, lines = np.bincount(element, mass, n).tolist(), np.bincount(element, minlength=n).tolist()
    last, best = list(range(n)), [0] * n
    weight = [PRIOR if t == "main" else 1.0 for t in tag]
    for e in range(n - 1, 0, -1):  # children come after their parents
        up = parent[e]
        held[up] += held[e]
        lines[up] += lines[e]
        last[up] = max(last[up], last[e])
        if lines[e] > 1 and (not best[up] or held[e] * weight[e] >= held[best[up]] * weight[best[up]]):
            best[up] = e
    at, total = 0, held[0]
    while best[at] and held[best[at]] * weight[best[at]] >= SHARE * total:
        at = best[at]
    return at, last[at]


def choose(lines: list[Line], parent: list[int], tag: list[str], sigma: float, cut: float | None = None) -> tuple[np.ndarray, int]:
    """Which lines (none of them skipped) are main text, and the number of the content region's element; cut replaces the threshold."""
    text, tags, linked = (np.array([x[k] if k else len(x[k]) for x in lines], float) for k in range(3))
    element = np.array([x.element for x in lines])
    plain = text - linked
    sharp = plain / np.maximum(1, tags)
    ratio = smooth(sharp, sigma)
    if ratio.max() <= 2 * max(ratio.min(), 1e-9):  # one cluster: nothing stands out
        sharp = ratio = np.ones(len(lines))
    cut = threshold(ratio) if cut is None else cut
    dense, own = ratio >= cut, 2 * linked < text
    if (dense & own).any():  # smoothing lifts no line of links
        dense &= own
    first, last = region(parent, tag, element, np.where(dense, np.maximum(plain, 0) + 1, 0))
    inside = (element >= first) & (element <= last)
    if (dense & inside & (sharp >= cut)).any():  # what only its neighbours lift says nothing of its kind
        dense &= sharp >= cut
    # a line that stands in the region's own element, not in a block of it, is of the region's kind
    kind = np.array([(-1, "") if e == first else (parent[e], tag[e]) for e in element.tolist()], "i8,U16")
    near = np.isin(kind, kind[dense & inside]) | np.isin(element, element[dense & inside])
    at = np.flatnonzero(dense & inside)
    near[at[0] : at[-1] + 1] = True
    keep = inside & (dense | near & own)
    if all(tag[e] in HEADING for e in element[keep].tolist()):  # headings alone are no text: they head the region's other lines
        keep |= inside & own
    k = int(np.argmax(keep)) - 1
    while k >= 0 and tag[element[k]] in HEADING and not linked[k]:  # headings stand outside what they head
        keep[k] = True
        k -= 1
    return keep, first


def finished(html: str) -> str:
    """The page without a tag that never ends."""
    cut = UNFINISHED.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def extract(html: str, sigma: float = 1.0, cut: float | None = None) -> str:
    parser = Blocks()
    parser.feed(finished(html))
    parser.close()
    parser.cut()
    lines = [x for x in parser.lines if not x.skipped]
    if len(lines) < 2:
        return " ".join(x.text for x in lines)
    keep, _ = choose(lines, parser.parent, parser.tag, sigma, cut)
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, sigma: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (main text, empty if none), n_chars (its code points).

    Null html counts as empty.  Null ids and urls and repeated rows stay; other columns, also ones named as the
    results are, are ignored.  Markup cut off at the end of a page is no text.  A page of any length or depth is
    parsed whole, in time linear in its length, and held by one task.  Pages whose lines are all skipped have no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 1 << 22):
            text = [extract(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
