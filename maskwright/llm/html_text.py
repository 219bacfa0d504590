"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block boundaries cut the page into lines, each with the text it holds,
the tags passed, the elements it lies in, and how many of these are by their tag, class, id or role of what isn't an
article: menus, headers, footers, sidebars, notices, adverts, forms, reader comments. The ratio of a line's text to its
tags, linked text left out, is multiplied by PENALTY for each such element; it is smoothed with a Gaussian along lines
that lie equally deep in them, and lines above a threshold of its deviation form the content cluster. As ratios are
compared with each other, a wrapper around all of a page by any such name changes nothing. The region selected is the
article or main element around most of the cluster's text, or else the innermost element that holds all of the
cluster, from the cluster's first line to its last; of these lines, those of the cluster stay and those that lie no
deeper in elements of other kinds than the cluster does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIGMA, THRESHOLD, MAJORITY = 1.0, 0.5, 0.75
#: What an element of another kind than the article leaves of the ratios in it.
PENALTY = 0.001
CHUNK = 1 << 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
AREAS = frozenset("article body div main section table td tr tbody center html blockquote ul ol dl".split())
#: What a page doesn't show as text, or shows for input only.
NEVER = frozenset("head title script style noscript template iframe object svg math canvas button select option textarea input audio video map datalist".split())
APART = frozenset("nav footer aside form menu dialog".split())
#: Words of class names and ids, and roles, of what isn't the article.
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted sidebar sidebars side rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer foot cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "signin login share sharing social related recommended recommendations comment comments commentlist disqus discussion responses reply replies respond widget widgets toolbar "
    "pagination pager paging search searchbox masthead topbar skip hidden copyright legal disclaimer form".split()
)
HEAD_SIGNS = frozenset(("header", "head", "top"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_PART = re.compile(r"[^a-z0-9]+")
#: Elements that a start tag closes, up to the elements that bound them.
IMPLIED = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
BOUNDS = {"p": frozenset("article aside blockquote body button div dd details fieldset figcaption figure footer form header html li main nav section table td th".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "option": frozenset(("select",))}


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, linked characters, area, heading?, depth in elements of other kinds)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # name, never text, id of the area, depth
        self.areas: list[tuple[int, str]] = [(-1, "")]  # parent area, name
        self.inside = 0  # open article and main elements
        self.links = 0
        self.parts: list[tuple[int, bool, str]] = []  # depth, linked, text
        self.tags = 1
        self.heading = False
        self.lines: list[tuple[str, int, int, int, bool, int]] = []

    def cut(self) -> None:
        # An inline element of another kind within a paragraph makes a line of its own.
        for depth in sorted({d for d, _, x in self.parts if x.strip()}):
            own = [(linked, x) for d, linked, x in self.parts if d == depth]
            text = " ".join("".join(x for _, x in own).split())
            if text:
                self.lines.append((text, self.tags, sum(len(x) for linked, x in own if linked), self.stack[-1][2], self.heading, depth))
                self.tags = 1
        self.parts = []
        self.heading = False

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            if name in ("article", "main"):
                self.inside -= 1
            elif name == "a":
                self.links -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.cut()
            self._imply("p")  # a block ends a paragraph
            if tag in IMPLIED and tag != "p":
                self._imply(tag)
            if tag == "body":
                depth = next((i for i, e in enumerate(self.stack) if e[0] == "head"), 0)
                if depth:
                    self.pop(depth)
        elif tag == "br":
            self.parts.append((self.stack[-1][3], False, " "))
        if tag in VOID:
            return
        if tag == "a":
            depth = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == "a"), 0)
            if depth:
                self.pop(depth)
            self.links += 1
        _, never, area, depth = self.stack[-1]
        if tag in AREAS:
            self.areas.append((area, tag))
            area = len(self.areas) - 1
        named = bool(attrs) and tag not in ("html", "body", "article", "main") and self._sign(tag, attrs)
        depth += tag in APART or tag == "header" and not self.inside or named
        if tag in ("article", "main"):
            self.inside += 1
        self.stack.append((tag, never or tag in NEVER, area, depth))
        if block and tag in ("h1", "h2"):
            self.heading = tag == "h1"

    def _imply(self, name: str) -> None:
        ends, bounds = IMPLIED[name], BOUNDS[name]
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in ends:
                self.pop(i)
                return
            if self.stack[i][0] in bounds:
                return

    def _sign(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if not value:
                continue
            if key == "role" and value.lower() in ROLES:
                return True
            if key == "style" and "display:none" in value.replace(" ", "").lower():
                return True
            if key in ("class", "id"):
                for name in value.lower().split():
                    words = _PART.split(name)
                    if words[0] in ("has", "with", "no", "is"):
                        continue
                    if any(w in SIGNS for w in words) or not self.inside and words[-1] in HEAD_SIGNS:
                        return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash closes nothing in HTML but elements that are void anyway
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if self.stack[i][0] in ("article", "main", "body", "table") and tag not in AREAS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append((self.stack[-1][3], bool(self.links), data))


_RADIUS = max(1, math.ceil(3 * SIGMA))
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-_RADIUS, _RADIUS + 1)]


def content_cluster(lines: list[tuple[str, int, int, int, bool, int]]) -> list[bool]:
    """Which lines' smoothed text-to-tag ratios exceed THRESHOLD deviations; linked text counts for nothing."""
    ratio = [max(0, len(text) - linked) / tags * PENALTY**depth for text, tags, linked, _, _, depth in lines]
    n = len(ratio)
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for side in (range(i, max(-1, i - _RADIUS - 1), -1), range(i + 1, min(n, i + _RADIUS + 1))):
            for k in side:
                if lines[k][5] != lines[i][5]:
                    break
                total += _KERNEL[k - i + _RADIUS] * ratio[k]
                weight += _KERNEL[k - i + _RADIUS]
        smooth.append(total / weight)
    mean = sum(smooth) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / n)
    return [x >= THRESHOLD * deviation and x > 0 for x in smooth]


def main_text(html: str | None) -> str:
    """The article of a page; null, empty and unreadable pages give an empty text."""
    p = _Lines()
    html = html or ""
    for at in range(0, len(html), CHUNK):
        p.feed(html[at : at + CHUNK])
    p.close()
    p.cut()
    lines = p.lines
    if not lines:
        return ""
    chosen = content_cluster(lines)
    if not any(chosen):
        chosen = [x[5] == min(y[5] for y in lines) for x in lines]
    depth = min(x[5] for x, use in zip(lines, chosen) if use)
    held: dict[int, int] = {}
    for (text, _, _, area, _, _), use in zip(lines, chosen):
        if use:
            while area >= 0:
                held[area] = held.get(area, 0) + len(text)
                area = p.areas[area][0]
    total = held[0]
    # Areas are numbered as they open, so the innermost one that holds most has the largest number.
    region = max(a for a, n in held.items() if n >= MAJORITY * total)
    chosen_from = 0
    around = region
    while around >= 0:
        if p.areas[around][1] in ("article", "main"):
            region = around
            break
        around = p.areas[around][0]
    else:  # no such element: the innermost one that holds all of the cluster, from its first line to its last
        region = max(a for a, n in held.items() if n == total)
        use = [i for i, x in enumerate(chosen) if x]
        lines, chosen = lines[: use[-1] + 1], chosen[: use[-1] + 1]
        chosen_from = use[0]

    def within(area: int) -> bool:
        while area > region:
            area = p.areas[area][0]
        return area == region

    out = [(i, x[0]) for i, x in enumerate(lines) if i >= chosen_from and within(x[3]) and (chosen[i] or x[5] <= depth)]
    first = out[0][0] if out else 0
    title = next((i for i in range(first - 1, -1, -1) if lines[i][4] and lines[i][5] <= depth), None)
    if title is not None and not any(chosen[title + 1 : first]) and not any(lines[i][4] for i, _ in out):
        out.insert(0, (title, lines[title][0]))
    return "\n\n".join(text for _, text in out)


def extract_text(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of *pages*, whole html in, main text out.

    Null html counts as empty. Repeated rows give repeated rows. No rows in, no rows out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE: dict[str, str] = {}
