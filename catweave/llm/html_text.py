"""Main text of web pages: parser events, text-to-tag ratios, smoothing, and threshold clustering.

The standard library's streaming parser turns a page into lines: what lies between two boundaries of
block elements.  The ratio of text to tags per line is smoothed with a Gaussian; lines above the threshold
(the standard deviation of the smoothed ratios) are content.  Names of elements, classes and roles are a
signal in the ratio: what they mark as boilerplate counts as a line without text.  A mark by class or id
alone is overruled where hardly anything would be left of the page without it.

The content region is chosen by the clustered text: the innermost container (division, section, table cell
and the like, whatever its name) that holds nine tenths of it, widened to the containers around as long as
they add a little text and no links.  All of the region's lines but the marked ones are the main
text, and with them lines elsewhere that are content by their own ratio and by the smoothed one.  A
region that is the whole body goes from the first line that is content by its own ratio too, or the headings
before it, to the last such line.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML without content, those that start a new line, and those never shown
#: or never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
HIDDEN = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form head iframe input map menu nav noembed noframes noscript object "
    "optgroup option script search select style svg template textarea title video".split()
)
CONTAINER = frozenset("article body center div html main section td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Words of class and id names, and roles, that mark boilerplate.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "discussion disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
#: Elements that a start tag closes if they are open, with no end tag of theirs.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPLIT = re.compile(r"[^a-z]+")
_NAME = re.compile(r"([a-z])([A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


HARD, SOFT, TITLE = 1, 2, 4


@dataclass
class Line:
    """A line: its text, the tags since the line before, characters inside links, marks, and where it lies."""

    text: str
    tags: int
    links: int
    mark: int
    path: tuple[int, ...]  # containers around it, the outermost first
    soft: tuple[int, ...]  # elements around it that are marked by class or id
    heading: bool

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags)

    @property
    def is_link(self) -> bool:
        return 2 * self.links > len(self.text)


class _Open(NamedTuple):
    """An open element and what it hands down."""

    tag: str
    mark: int
    path: tuple[int, ...]
    soft: tuple[int, ...]
    heading: bool
    link: bool


_ROOT = _Open("", 0, (), (), False, False)


class _Lines(HTMLParser):
    """Collects a page's lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.good: list[str] = []
        self.bad: list[str] = []
        self.at: _Open | None = None  # where the line's first text stands
        self.tags = self.links = self.elements = 0
        self.bodies: set[int] = set()

    def flush(self) -> None:
        text, own = " ".join("".join(self.good).split()), self.at
        if not text:
            text, own = " ".join("".join(self.bad).split()), None
        if text:
            own = own or (self.open[-1] if self.open else _ROOT)
            self.lines.append(Line(text, self.tags, self.links, own.mark or (0 if self.at and self.good else HARD), own.path, own.soft, own.heading))
            self.tags = 0
        self.good.clear()
        self.bad.clear()
        self.at, self.links = None, 0

    def _close(self, i: int) -> None:
        self.flush()
        del self.open[i:]

    def _find(self, names: set[str], stop: frozenset[str]) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in names:
                return i
            if self.open[i].tag in stop:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if tag not in VOID and (i := self._find({"p"}, _P_SCOPE)) >= 0:
                self._close(i)
            if tag in CLOSES and (i := self._find(CLOSES[tag], _LIST_SCOPE)) >= 0:
                self._close(i)
        if tag in VOID:
            return
        _, mark, path, soft, heading, link = self.open[-1] if self.open else _ROOT
        self.elements += 1
        if tag in CONTAINER:
            path = (*path, self.elements)
            if tag in ("body", "html"):
                self.bodies.add(self.elements)
        new = _boilerplate(tag, attrs) if attrs else 0
        if new & SOFT:
            soft = (*soft, self.elements)
        if tag in HIDDEN:
            new |= HARD
        if tag == "header" or new & TITLE:
            # Of the page, or of an article: the region decides.
            mark |= TITLE
        self.open.append(_Open(tag, mark | new, path, soft, heading or tag in HEADING, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        own = self.open[-1] if self.open else _ROOT
        if own.mark & HARD:
            self.bad.append(data)
            return
        if self.at is None and not data.isspace():
            self.at = own
        self.good.append(data)
        if own.link:
            self.links += len(data.strip())


_P_SCOPE = frozenset("td th table button object caption html".split())
_LIST_SCOPE = frozenset("ul ol dl table html select".split())


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What the attributes of an element mark it as."""
    if tag in ("html", "body"):
        return 0
    mark = 0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value or ""):
            mark |= HARD
        if name == "role" and value in ROLES:
            mark |= HARD
        if name in ("class", "id") and value:
            words = set(_SPLIT.split(_NAME.sub(r"\1 \2", value).lower()))
            if words & WORDS:
                mark |= SOFT
            if "header" in words:
                mark |= TITLE
    return mark


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the ends' weights made up for."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    if len(ratio) < 2 * radius + 1:
        pad = 2 * radius + 1 - len(ratio)
        weight = np.convolve(np.append(np.ones(len(ratio)), np.zeros(pad)), kernel, "same")[: len(ratio)]
        return np.convolve(np.append(ratio, np.zeros(pad)), kernel, "same")[: len(ratio)] / weight
    return np.convolve(ratio, kernel, "same") / np.convolve(np.ones(len(ratio)), kernel, "same")


def lines_of(html: str) -> tuple[list[Line], set[int]]:
    """A page's lines, and which containers are its body."""
    parser = _Lines()
    for at in range(0, len(html), 1 << 16):
        parser.feed(html[at : at + (1 << 16)])
    parser.close()
    parser.flush()
    return parser.lines, parser.bodies


def marked(lines: list[Line]) -> list[bool]:
    """Which lines count as boilerplate."""
    bad = [bool(x.mark & HARD or x.soft) for x in lines]
    over: set[int] = set()
    while True:
        left = sum(len(x.text) for x, b in zip(lines, bad) if not b)
        held: dict[int, int] = {}
        for x in lines:
            if not x.mark & HARD:
                for e in x.soft:
                    if e not in over:
                        held[e] = held.get(e, 0) + len(x.text)
        # The outermost of the marked elements that hold nearly all there is.
        most = min((e for e, n in held.items() if left < n * LITTLE), default=None)
        if most is None:
            return bad
        over.add(most)
        bad = [bool(x.mark & HARD or set(x.soft) - over) for x in lines]


def content(lines: list[Line], bad: list[bool], sigma: float = 1.0) -> tuple[np.ndarray, float]:
    """Which lines lie above the threshold, and the threshold: the standard deviation of the smoothed ratios."""
    smooth = smoothed(np.array([0.0 if b or x.mark & TITLE else x.ratio for x, b in zip(lines, bad)]), sigma)
    limit = min(float(smooth.std()), float(smooth.max()))
    return smooth >= limit, limit


#: What is left beside a marked element, as a share of it, for the mark to be overruled; the share of the
#: clustered text that the region holds; what a wider container may add, as a share of the region.
LITTLE, MOST, ADDED = 0.05, 0.9, 0.25


def main_text(html: str, sigma: float = 1.0) -> str:
    """The main text of one page."""
    lines, bodies = lines_of(html)
    if not lines:
        return ""
    bad = marked(lines)
    dense, limit = content(lines, bad, sigma)
    good = [i for i, (x, b) in enumerate(zip(lines, bad)) if not b and not x.mark & TITLE]
    clustered = [i for i in good if dense[i]] or good
    if not clustered:
        return ""
    mass: dict[int, int] = {}
    for i in clustered:
        for e in lines[i].path:
            mass[e] = mass.get(e, 0) + len(lines[i].text)
    total = sum(len(lines[i].text) for i in clustered)
    holders = [e for e, n in mass.items() if n >= MOST * total and e not in bodies]
    if not holders:
        own = [i for i in clustered if lines[i].ratio >= limit] or clustered
        first, last = own[0], own[-1]
        while first and lines[first - 1].heading and not bad[first - 1] and first - 1 in good:
            first -= 1
        return " ".join(lines[i].text for i in good if first <= i <= last and not (lines[i].is_link and not dense[i]))
    # Containers are numbered as they open, so the innermost of those around the same text is the last.
    region = max(holders)
    path = next(lines[i].path for i in clustered if region in lines[i].path)
    for outer in reversed(path[: path.index(region)]):
        own = [lines[i] for i in good if outer in lines[i].path]
        more = [x for x in own if region not in x.path]
        if outer in bodies or any(x.is_link for x in more) or sum(len(x.text) for x in more) > ADDED * sum(len(x.text) for x in own if region in x.path):
            break
        region = outer
    # An article's own header lies inside the region.
    chosen = [i for i, x in enumerate(lines) if not bad[i] and (region in x.path or not x.mark & TITLE and dense[i] and x.ratio >= limit and not x.is_link)]
    return " ".join(lines[i].text for i in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null, empty or textless page gives an empty text; broken markup is read as far as it goes; repeated
    rows each give a row; other columns are ignored.  Pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [main_text(h.as_py() or "") for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
