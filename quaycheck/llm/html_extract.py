"""Main text of web pages from streamed parser events and smoothed text-to-tag ratios.

The standard library's parser sends events; text between block tags is a line with its characters and tags. Elements
that never hold the article (menus, headers, footers, asides, forms, adverts, notices, comments, scripts) are known by
tag, role or class words. The ratio of characters to tags of every shown line is smoothed with a Gaussian, and a
threshold on the smoothed ratio (its standard deviation, or its mean if smaller) splits lines into content and the
rest. The region is the deepest element that holds most of the content lines' characters: half of them for an
article or main element, three quarters for others. All of its lines that are not of an excluded kind are returned,
short ones too. Where no line passes, all shown lines count as content.

Null or empty html gives an empty text. Cut-off tags and comments at the end are dropped; elements left open end with
the page. Null ids, urls and repeated rows pass unchanged; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import per_batch

#: Fixed values of the page language: elements without an end tag, and elements that start a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements, roles and class words of what is not the article.
LEFT_OUT = frozenset("aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola teaser toc toolbar widget widgets".split()
)
#: Words of class names that only tell what a wrapper has beside the article ("with-sidebar").
WRAPS = frozenset("enabled has no with without wrapper".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def left_out(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is of a kind that does not hold the article."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") or name == "class" and tag == "article":
                words = set(_SPLIT.split(value)) - ({"header"} if in_article else set())
                if not WORDS.isdisjoint(words) and WRAPS.isdisjoint(words):
                    return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


class Lines(HTMLParser):
    """Gathers lines: (text, tags, element). Elements are numbered as they open; `parent` and `kind` describe them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.parent, self.kind, self.out = [-1], ["page"], [False]
        self.open = [("page", 0)]
        self.parts: list[str] = []
        self.tags = 0
        self.articles = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.lines.append((text, self.tags, self.open[-1][1]))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK:
            if any(a[0] in ("class", "role", "hidden", "aria-hidden", "style") for a in attrs) and tag not in VOID and left_out(tag, attrs, self.articles > 0):
                self.push(tag, True)
            return
        self.flush()
        if self.open[-1][0] == "p":
            self.open.pop()
        if tag not in VOID:
            self.push(tag, left_out(tag, attrs, self.articles > 0))

    def push(self, tag: str, out: bool) -> None:
        self.flush()
        above = self.open[-1][1]
        self.parent.append(above)
        self.kind.append(tag)
        self.out.append(out or self.out[above])
        self.articles += tag in ("article", "main")
        self.open.append((tag, len(self.kind) - 1))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.flush()
                self.articles -= sum(t in ("article", "main") for t, _ in self.open[i:])
                del self.open[i:]
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parsed(html: str) -> Lines:
    p = Lines()
    cut = html.rfind("<")
    p.feed(html if cut < 0 or ">" in html[cut:] or not html[cut + 1 : cut + 2].isalpha() and html[cut + 1 : cut + 2] not in ("/", "!", "?") else html[:cut])
    p.close()
    p.flush()
    return p


def gaussian(sigma: float) -> np.ndarray:
    x = np.arange(-int(np.ceil(3 * sigma)), int(np.ceil(3 * sigma)) + 1)
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def content(ratios: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Lines whose smoothed ratio passes the threshold."""
    half = len(kernel) // 2
    smooth = np.convolve(np.pad(ratios, half, mode="edge"), kernel, mode="valid")
    return smooth >= min(smooth.std(), smooth.mean())


def main_text(html: str | None, kernel: np.ndarray) -> str:
    if not html:
        return ""
    p = parsed(html)
    shown = [line for line in p.lines if not p.out[line[2]]]
    if not shown:
        return ""
    chars = np.array([len(t) for t, _, _ in p.lines], float)
    ratios = chars / np.maximum(1, [n for _, n, _ in p.lines])
    passed = content(ratios, kernel)
    mass = np.zeros(len(p.kind))
    for (_, _, e), size, ok in zip(p.lines, chars, passed, strict=True):
        if ok and not p.out[e]:
            mass[e] += size
    if not mass.any():
        for t, _, e in shown:
            mass[e] += len(t)
    parent = p.parent
    for e in range(len(parent) - 1, 0, -1):
        mass[parent[e]] += mass[e]
    region = 0
    for e in range(1, len(parent)):  # a child comes after its parent
        if p.kind[e] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "tr", "td", "th", "dd", "dt", "dl", "figure") or p.out[e]:
            continue
        need = 0.5 if p.kind[e] in ("article", "main") else 0.75
        if mass[e] >= need * mass[0] and _inside(parent, e, region):
            region = e
    return "\n".join(t for t, _, e in shown if _inside(parent, e, region))


def _inside(parent: list[int], e: int, region: int) -> bool:
    while e > region:
        e = parent[e]
    return e == region


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", sigma: float = 1.0) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kernel = gaussian(sigma)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, kernel) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url, "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return own.mapInArrow(per_batch(run), f"{id_col} long, {url} string, text string, n_chars long")
