"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into lines.  A line's ratio is
its text length over the tags in it.  Lines inside menus, headers, footers, sidebars, notices, adverts, forms
and reader comments (by element, role, class or id) have ratio 0.  The ratios are smoothed by a Gaussian and
clustered into two by an iterated threshold; lines over it are content.

- A container whose class or id only contains a boilerplate word among others ("has-sidebar", "social-science")
  is pardoned if it holds most of the content, unless there is an article with text outside it.
- Content votes for the innermost <article> or <main> that holds it: those with votes are given whole, without
  their boilerplate lines, so that short paragraphs and headings between long ones survive.
- On pages without them, content chooses the innermost container with four fifths of it, which is given
  likewise but for lines of links before the first and after the last line of content.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import table

SIGMA = 1.0  # lines

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_SKIP = set("script style noscript template head title iframe object svg math canvas audio video button select textarea form nav aside footer dialog menu".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = set("article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section table td th ul".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination "
    "popup promo promotion related respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
# Words that say where or what shape a container is, not what it holds.
_PLACES = set("area bar block bottom box container item left list main page right section site slot top unit wrap wrapper".split())
_MODIFIERS = {"has", "no", "not", "with", "without"}
_REGIONS = {"article", "blockquote", "body", "center", "div", "html", "main", "section", "td"}
_CUT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
SURE, MAYBE = 2, 1


def _named(token: str) -> int:
    parts = [x.lower() for x in _CUT.split(token) if x]
    if token.lower() in _NAMES:
        return SURE
    if not any(x in _NAMES for x in parts):
        return 0
    return SURE if all(x in _NAMES or x in _PLACES for x in parts) and parts[0] not in _MODIFIERS else MAYBE


def _boilerplate(tag: str, attrs: dict[str, str | None], inside: bool) -> int:
    """Whether an element is boilerplate: SURE, MAYBE (by a word in a name) or 0."""
    if tag in _SKIP or (tag == "header" and not inside):
        return SURE
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return SURE
    if (attrs.get("role") or "").lower() in _ROLES:
        return SURE
    return max((_named(x) for name in ("class", "id") for x in (attrs.get(name) or "").split()), default=0)


class Line(NamedTuple):
    text: str
    tags: int
    dull: bool  # surely boilerplate
    maybe: int  # innermost container that may be boilerplate; 0: none
    article: int  # innermost article or main; 0: none
    region: int  # innermost container
    linked: int  # length of what is within links


class Open(NamedTuple):
    tag: str
    dull: bool = False
    maybe: int = 0
    article: int = 0
    region: int = 0
    link: bool = False


class Page(HTMLParser):
    """Lines of a page.  Articles, containers and what may be boilerplate are numbered from 1 as they open;
    `above` and `around` have the number next outside, of the containers and of the others in turn."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.parts: list[str] = []
        self.above, self.around = [0], [0]
        self.tags = self.articles = self.linked = 0
        self.feed(html)
        self.close()
        self._line()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1] if self.open else Open("")
            self.lines.append(Line(text, self.tags, at.dull, at.maybe, at.article, at.region, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, names: set[str], until: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return
            if self.open[k].tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._line()
            self._pop({"p"}, _HOLDS)
            if tag in _CLOSES:
                self._pop(_CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        _, dull, maybe, article, region, link = self.open[-1] if self.open else Open("")
        named = {k: v for k, v in reversed(attrs)}
        # An inline element that is boilerplate makes a line of its own, so that its text can be told apart.
        mine = _boilerplate(tag, named, article > 0)
        if mine and not dull and tag not in _BLOCK:
            self._line()
        if tag in ("article", "main"):
            self.articles += 1
            article = self.articles
        if tag in _REGIONS:
            self.above.append(region)
            region = len(self.above) - 1
        if mine == MAYBE and not dull:
            self.around.append(maybe)
            maybe = len(self.around) - 1
        self.open.append(Open(tag, dull or mine == SURE, maybe, article, region, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == tag), None)
        if tag in _BLOCK or at is not None and self.open[at][1:3] != (self.open[at - 1][1:3] if at else (False, 0)):
            self._line()
        if at is not None:
            # A stray inline end tag does not close the blocks around it.
            if tag in _BLOCK or not any(x.tag in _BLOCK for x in self.open[at + 1 :]):
                del self.open[at:]
            else:
                del self.open[at]

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open and self.open[-1].link:
            self.linked += len(data.strip())


def threshold(x: np.ndarray) -> float:
    """Midpoint between the means of two clusters, iterated to rest (from the mean)."""
    at = float(x.mean())
    for _ in range(50):
        high, low = x[x >= at], x[x < at]
        if not len(low) or not len(high):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = float(new)
    return at


def _content(lines: list[Line], dull: np.ndarray) -> np.ndarray:
    """Which lines are content, by their smoothed text-to-tag ratio."""
    ratio = np.array([0.0 if off else len(x.text) / max(x.tags, 1) for x, off in zip(lines, dull, strict=True)])
    if not ratio.any():
        return np.zeros(len(lines), bool)
    reach = int(3 * SIGMA)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratio, reach), bell / bell.sum(), "valid")
    content = (smooth >= threshold(smooth)) & (ratio > 0)
    return content if content.any() else ratio == ratio.max()


def _pardoned(page: Page, dull: np.ndarray, content: np.ndarray) -> set[int]:
    """What may be boilerplate by a name but holds most of the content."""
    size = np.zeros(len(page.around))
    inside: list[set[int]] = [set() for _ in page.around]  # articles with text
    for k in np.flatnonzero(~dull):
        line = page.lines[k]
        at = line.maybe
        while at:
            size[at] += len(line.text) * content[k]
            inside[at].add(line.article)
            at = page.around[at]
    articles = {page.lines[k].article for k in np.flatnonzero(~dull)} - {0}
    total = sum(len(page.lines[k].text) for k in np.flatnonzero(content))
    return {at for at in range(1, len(size)) if 2 * size[at] > total and not articles - inside[at]}


def _region(page: Page, content: np.ndarray) -> set[int]:
    """The innermost container with four fifths of the content, and all containers in it.  One with a single
    line of several is but a wrapper of that line."""
    size, count = np.zeros(len(page.above)), np.zeros(len(page.above), int)
    for k in np.flatnonzero(content):
        size[page.lines[k].region] += len(page.lines[k].text)
        count[page.lines[k].region] += 1
    for at in range(len(size) - 1, 0, -1):
        size[page.above[at]] += size[at]
        count[page.above[at]] += count[at]
    top = int(np.flatnonzero((size >= 0.8 * size[0]) & (count >= min(2, count[0])))[-1])
    held = {top}
    for at in range(top + 1, len(size)):
        if page.above[at] in held:
            held.add(at)
    return held


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, one a line.  Null and empty pages have none."""
    page = Page(html or "")
    lines = page.lines
    dull = np.array([x.dull for x in lines], bool)
    content = _content(lines, dull)
    if any(x.maybe for x in lines):
        pardoned = _pardoned(page, dull, content)
        guilty = [False]
        for at in range(1, len(page.around)):
            guilty.append(at not in pardoned or guilty[page.around[at]])
        dull |= np.array([guilty[x.maybe] for x in lines], bool)
        content = _content(lines, dull)
    if not content.any():
        return ""
    voted = {lines[k].article for k in np.flatnonzero(content)} - {0}
    if voted:
        return "\n".join(x.text for x, off in zip(lines, dull, strict=True) if not off and x.article in voted)
    held = _region(page, content)
    first, last = np.flatnonzero(content)[[0, -1]]
    return "\n".join(x.text for k, x in enumerate(lines) if not dull[k] and x.region in held and (content[k] or first < k < last or 2 * x.linked < len(x.text)))


def _texts(batches):
    for batch in batches:
        out = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of `pages`: (page_id, url, text, n_chars).

    A null html is empty; ids and urls are passed on as they are, null and repeated ones too.  Other columns
    are ignored.  Broken markup is read as far as the parser's events make sense of it.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
