"""Main text of HTML pages by text-to-tag ratios.

Events of the standard library's streaming parser give the page's lines (the text between
block boundaries) with the tags that fall on each. The text-to-tag ratios, smoothed by a
Gaussian, are split into two clusters by a threshold; the lines of the upper cluster mark
the content region: the article that holds at least the share ``REGION`` of their text, or else
the innermost element that holds it, with articles beside it that hold the share ``BESIDE``. All
lines of that region are the text, without what lies inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, blocks or not.

Defined cases: null and empty pages, and pages without such lines, give an empty text;
unclosed and stray tags are tolerated; whole pages are parsed, however long; rows that
repeat an id are separate; other columns are not read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0  # of the smoothing, in lines
REGION = 0.8  # share of the content that an element must hold to be the region
BESIDE = 0.1  # share of all text that an article beside the region must hold to stay with it

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template svg math iframe button select textarea head title dialog menu object canvas audio video fieldset search".split())
REGIONS = frozenset("article main section div td body".split())
#: Words of class and id names that mark what is not the article.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription sidebar sidenav widget widgets related recommended recommendations comment comments commentlist reply replies respond disqus share sharing social breadcrumb breadcrumbs"
    " menu nav navbar navigation topbar toolbar footer pagination pager login signup signin paywall banner".split()
)
OUTER_NAMES = frozenset("header masthead hero".split())  # only outside an article
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CLOSES_P = BLOCKS - frozenset("br body html head button title template noscript".split())
names = re.compile(r"[A-Za-z]+").findall


class Page(HTMLParser):
    """Collects (text, tags, region) of each line; text inside dropped elements is left out.

    Regions are numbered in page order; ``parents`` leads from a region to the one around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, int, bool]] = [("", False, -1, False)]  # tag, dropped, region, in an article
        self.at: dict[str, list[int]] = {}  # where each tag's open elements stand in ``open``
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.open[-1][2]))
        self.parts, self.tags = [], 0

    def drops(self, tag: str, attrs: list, in_article: bool) -> bool:
        if tag in DROPPED or tag == "header" and not in_article:
            return True
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return True
            if name in ("class", "id") and value and tag not in ("body", "html", "article", "main"):
                words = {w.lower() for w in names(value)}
                if words & DROPPED_NAMES or not in_article and words & OUTER_NAMES:
                    return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in CLOSES_P:
            self.close_to("p", "article", "main", "section", "div", "td", "body", "li", "blockquote")
        if tag == "li":
            self.close_to("li", "ul", "ol", "menu")
        if tag in VOID:
            return
        _, dropped, region, in_article = self.open[-1]
        dropped = dropped or self.drops(tag, attrs, in_article)
        if tag in REGIONS:
            self.parents.append(region)
            region = len(self.kinds)
            self.kinds.append(tag)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, dropped, region, in_article or tag in ("article", "main")))

    def close_to(self, tag: str, *bars: str) -> None:
        """Close the innermost open element of the name, unless a bar is met before."""
        mine = self.at.get(tag)
        if mine and not any(self.at.get(b) and self.at[b][-1] > mine[-1] for b in bars):
            i = mine[-1]
            while len(self.open) > i:
                self.at[self.open.pop()[0]].pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in REGIONS or tag in DROPPED or tag in ("html", "header"):
            self.close_to(tag)
        else:  # a stray inline or paragraph end closes nothing outside its region
            self.close_to(tag, *REGIONS)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones_like(ratios), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """Border between the two clusters of one-dimensional 2-means."""
    low, high = float(values.min()), float(values.max())
    border = (low + high) / 2
    for _ in range(rounds):
        upper = values >= border
        if upper.all() or not upper.any():
            break
        after = (values[upper].mean() + values[~upper].mean()) / 2
        if abs(after - border) < 1e-9:
            break
        border = float(after)
    return border


def held(lines: list, parents: list[int], which: list[int]) -> tuple[int, list[int]]:
    """Characters of some lines, in all and in each region."""
    weight = [0] * len(parents)
    for i in which:
        if lines[i][2] >= 0:
            weight[lines[i][2]] += len(lines[i][0])
    for k in range(len(parents) - 1, -1, -1):  # a region comes after the one around it
        if parents[k] >= 0:
            weight[parents[k]] += weight[k]
    return sum(len(lines[i][0]) for i in which), weight


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    lines, parents = page.lines, page.parents
    usable = [i for i, (text, *_) in enumerate(lines) if text]
    if not usable:
        return ""
    values = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in lines]))
    border = threshold(values)
    total, weight = held(lines, parents, [i for i in usable if values[i] >= border] or usable)
    whole, share = held(lines, parents, usable)
    most = [k for k, w in enumerate(weight) if w >= REGION * total]
    articles = [k for k in most if page.kinds[k] in ("article", "main")]
    if not most:
        return "\n".join(lines[i][0] for i in usable)
    region = max(articles, key=lambda k: (weight[k], k)) if articles else most[-1]
    # an article beside it that holds a share of its own is part of the page's text
    beside = lambda k: page.kinds[k] == page.kinds[region] == "article" and parents[k] == parents[region] and share[k] >= BESIDE * whole
    inside = []
    for k, parent in enumerate(parents):
        inside.append(k == region or beside(k) or parent >= 0 and inside[parent])
    return "\n".join(lines[i][0] for i in usable if lines[i][2] >= 0 and inside[lines[i][2]])


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with ``text`` and its length in code points, one row per page."""
    kept = pages.select(*keep, F.col(html).alias("__html"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    schema = kept.drop("__html").schema
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "text string", "n_chars long"]))
