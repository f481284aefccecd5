"""Main text of web pages: text-to-tag ratio of lines, smoothed, with a threshold that picks the content regions.

A page is read as a stream of events of the standard library's parser; no tree is built. A line is the text between two
block borders. Its ratio is its code points over the tags met since the line before. The ratios of a page are smoothed
with a Gaussian kernel, and lines above the standard deviation of the smoothed ratios form the clusters that mark
regions as content. Every line of a content region is kept, short ones too.

What the markup says outright comes before the ratios. Lines in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (by element, role, class or id) and hidden lines have ratio 0 and are never kept. Where a page
has text in ``article`` elements, only these are regions; where it has none, ``main`` elements; else any nearest block container.
Of loose lines in the body, those between its first and last line above the threshold are kept.

Rules for odd input: null counts as empty; a page without content gives an empty text. White space is what Unicode calls so, and ``br`` counts
as white space inside its block. Unclosed elements end where the parser of a browser would end them (at the end of an outer element, or
of an article's); an unclosed comment or script runs to the end of the page, and a tag that never ends is no text. Pages are independent: ties, repeated
rows and empty tables need no rule. Other columns are left out, or carried by ``keep``. Time is in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowstream.llm.text import packed, quoted, unpacked

RADIUS = 2  # lines; standard deviation of the kernel, which reaches over twice as many
THRESHOLD = 1.0  # in standard deviations of the smoothed ratios

# Element names of HTML, and words by which pages call what is not their article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
NEVER_TEXT = set("""aside audio button canvas datalist dialog embed footer form iframe menu nav noframes noscript object script search select style
svg template textarea title video""".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = set("""ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertisements advertising advertorial alert banner breadcrumb breadcrumbs
comment commentlist comments consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices notification notifications pager pagination popup promo promoted promotion recommendations recommended related replies
reply respond responses share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar""".split())
PREFIXES = ("has-", "with-", "without-", "no-", "is-", "has_", "with_", "no_")

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "body", "div", "html", "main", "section", "td", "th"}
WHOLE = {"article", "body", "html", "main"}  # elements that a word of their class does not exclude, unless it is the whole class
LAYOUT = {"form", "header", "nav"}  # an article inside these is one all the same
STRUCTURE = {"article", "aside", "footer", "form", "header", "main", "nav", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}
BARRIERS = {"article", "main", "td", "th"}  # end tags of other elements don't reach past these
#: Elements that end an open one of the second set, unless one of the third set has begun since.
IMPLIED = {"li": ({"li"}, {"ol", "ul", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_LETTERS = re.compile(r"[^a-z]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def excluded_by(tag: str, attrs: Sequence[tuple[str, str | None]], in_article: bool) -> str:
    """Why an element's text is not the article's, or an empty string."""
    if tag in NEVER_TEXT or tag == "header" and not in_article:
        return tag
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN_STYLE.search(value):
            return "hidden"
        if name == "role" and value and value.strip().lower() in ROLES:
            return value.strip().lower()
        if name in ("class", "id", "aria-label") and value:
            for said in value.split():
                said = _CAMEL.sub("-", said).lower()
                if said.startswith(PREFIXES):
                    continue
                found = {said} & WORDS if tag in WHOLE else WORDS.intersection(_NOT_LETTERS.split(said))
                if tag in HEADINGS or in_article:
                    found -= {"header"}
                if found:
                    return min(found)
    return ""


class Lines(HTMLParser):
    """Lines of one page: (text, region, kind of region, is a heading, tags). Lines that are not the article's have no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, str, bool, int]] = []
        self._stack: list[tuple[str, str, int, str]] = []  # element, why excluded, region, kind of region
        self._at: dict[str, list[int]] = {}  # element: its places in the stack
        self._barriers: list[int] = []
        self._excluded, self._region, self._kind = "", 0, "body"
        self._parts: list[str] = []
        self._tags, self._left_out, self._heading, self._regions = 0, False, False, 0

    def read(self, html: str) -> list[tuple[str, int, str, bool, int]]:
        self.feed(html)
        # What the parser holds back at the end is text, or a construct that never ends. A start tag with an open
        # quote ends at its first bracket; that can happen once for each kind of quote.
        while self.rawdata and not self.cdata_elem:
            rest = self.rawdata
            self.rawdata = ""
            if re.match(r"<[A-Za-z]", rest) and ">" in rest:
                self._tags += 1
                self.feed(rest[rest.index(">") + 1:])
            elif not re.match(r"<[A-Za-z/!?]", rest):
                self.handle_data(unescape(rest))
        self._end_line()
        return self.lines

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # in HTML, "<![" begins a comment up to the next bracket

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text or self._left_out:
            self.lines.append((text, self._region, self._kind, self._heading, max(1, self._tags)))
            self._tags, self._left_out = 0, False
        self._parts.clear()

    def _push(self, tag: str, excluded: str, region: str) -> None:
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag in BARRIERS:
            self._barriers.append(len(self._stack))
        self._stack.append((tag, self._excluded, self._region, self._kind))
        self._excluded = excluded
        if region in CONTAINERS and not (self._kind == "article" or self._kind == "main" and region != "article"):
            self._regions += 1
            self._region, self._kind = self._regions, region if region in WHOLE else "part"

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            tag, self._excluded, self._region, self._kind = self._stack.pop()
            self._at[tag].pop()
            if tag in BARRIERS:
                self._barriers.pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _barrier(self) -> int:
        return self._barriers[-1] if self._barriers else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag == "br":
                self._parts.append(" ")
            return
        if tag in BLOCKS:
            self._end_line()
            p = self._last(["p"])
            if p > self._barrier():
                self._pop_to(p)
            if tag in IMPLIED:
                closed, within = IMPLIED[tag]
                place = self._last(closed)
                if place > self._last(within):
                    self._pop_to(place)
            self._heading = tag in HEADINGS
        outer = self._excluded
        if tag in ("article", "main") and outer in LAYOUT:
            outer = ""
        excluded = outer or excluded_by(tag, attrs, self._kind == "article")
        if tag in BLOCKS or tag in NEVER_TEXT or excluded != outer or self._at.get(tag):
            self._push(tag, excluded, "main" if ("role", "main") in attrs else tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # outside of foreign content, a slash at the end of a start tag means nothing
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in ("body", "html"):
            return
        if tag in BLOCKS:
            self._end_line()
            self._heading = False
        elif tag == "br":
            self._parts.append(" ")
        place = self._last([tag])
        if place > (-1 if tag in STRUCTURE else self._barrier()):
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if not self._excluded:
            self._parts.append(data)
        elif not self._left_out and not data.isspace():
            self._left_out = True


def smoothed(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over the neighbours of each line; beyond the page, ratios are 0."""
    reach = np.arange(-2 * radius, 2 * radius + 1)
    kernel = np.exp(-reach ** 2 / (2.0 * radius ** 2))
    return np.convolve(ratios, kernel / kernel.sum(), "full")[2 * radius:2 * radius + len(ratios)]


def page_text(html: str) -> str:
    """The lines of a page's content regions, joined by line breaks."""
    lines = Lines().read(html)
    kinds = {kind for text, _, kind, _, _ in lines if text}
    wanted = ("article",) if "article" in kinds else ("main",) if "main" in kinds else tuple(kinds)
    ratios = np.array([len(text) / tags if kind in wanted else 0.0 for text, _, kind, _, tags in lines])
    if not ratios.any():
        return ""
    smooth = smoothed(ratios)
    least = THRESHOLD * smooth.std()
    # a line in a cluster marks its region if it is dense itself or a heading, not only a neighbour of dense lines
    marks = [i for i in np.flatnonzero(smooth > least) if ratios[i] > least or lines[i][3] and ratios[i]] or [int(ratios.argmax())]
    reach: dict[int, tuple[int, int]] = {}
    for i in marks:
        region = lines[i][1]
        reach[region] = (min(i, reach.get(region, (i, i))[0]), i)
    out = []
    for i, (text, region, kind, _, _) in enumerate(lines):
        if text and kind in wanted and region in reach:
            first, last = reach[region]
            if kind not in ("body", "html") or first <= i <= last:
                out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, *, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page with its main text and that text's code points (text, n_chars)."""
    rows = pages.select(packed(keep, "_kept"), quoted(html_col).cast("binary").alias("_html"))
    schema = T.StructType([rows.schema["_kept"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text((html.as_py() or b"").decode("utf-8", "replace")) for html in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_kept", "text", "n_chars"])

    return rows.mapInArrow(extract, schema).select(*unpacked(keep, "_kept"), "text", "n_chars")
