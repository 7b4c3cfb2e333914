"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser gives events; every block of the page
becomes a line with its text length and tag count.  The ratio per line is
smoothed with a Gaussian kernel, a two-group threshold clusters the lines into
content and rest, and the region that holds the content text is kept whole:
the article (or main) element with most of it if the page marks one, else the
deepest element with nearly all of it, else everything from the first content
line to the last.  Elements that the page itself marks as navigation, notice,
advert, form, reader comment and the like never yield lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table
    tbody td tfoot th thead title tr ul""".split())
#: Start of one of these ends an open paragraph or head.
ENDS_PARAGRAPH = BLOCK - {"html", "body", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An open element that a sibling of the same group closes, and the parents that stop the search.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
EXCLUDED = frozenset("""head nav aside footer form script style noscript template svg iframe object select button textarea
    dialog menu search audio video canvas""".split())
MARKED = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social comment comments
    commentlist disqus reply replies respond related recommended recommendations sidebar menu nav navbar navigation breadcrumb
    breadcrumbs footer header masthead toolbar pagination pager widget widgets login signup search contentinfo complementary
    alertdialog""".split())
NAMES = re.compile(r"[a-z]+")
#: A class, id or role with one of these tells a state ("has-sidebar"), not a part of the page.
STATES = frozenset("has no not with without is".split())
#: Marks that say nothing beside these: the head of an entry, a section on related work.
OF_CONTENT = {"header": frozenset("entry post article content story".split()), "footer": frozenset("entry post article content story".split()),
              "related": frozenset("work works research".split())}
CONTAINERS = ("article", "main", "section", "div", "td")
#: Containers deeper than this count as the one above, so paths stay short.
DEEPEST = 64
#: Shares of the content text that an article or main, or any other container, must hold.
MOST, NEARLY_ALL = 0.5, 0.8


def marked(name: str) -> bool:
    """Whether a class, id or role names a part that is no article."""
    parts = set(NAMES.findall(name))
    return parts.isdisjoint(STATES) and any(parts.isdisjoint(OF_CONTENT.get(m, ())) for m in parts & MARKED)


class Lines(HTMLParser):
    """Parser events -> lines (text, tags, containers that hold it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple]] = []
        self.stack: list[tuple[str, bool, tuple]] = []  # tag, excluded, containers
        self.opened: Counter = Counter()
        self.text: list[str] = []
        self.tags = 0
        self.containers = 0

    def state(self) -> tuple[bool, tuple]:
        return self.stack[-1][1:] if self.stack else (False, ())

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.state()[1]))
        self.text, self.tags = [], 0

    def pop_to(self, size: int) -> None:
        for tag, _, _ in self.stack[size:]:
            self.opened[tag] -= 1
        del self.stack[size:]

    def updatepos(self, i, j):
        return j  # line numbers aren't needed

    def close_open(self, tags, stop) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return self.pop_to(i)
            if self.stack[i][0] in stop:
                return

    def excludes(self, tag: str, attrs: list, containers: tuple) -> bool:
        if tag in EXCLUDED or tag == "header" and not any(c[0] in ("article", "main") for c in containers):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(marked(name) for k, v in attrs if v and k in ("class", "id", "role") for name in v.lower().split())

    def parse_marked_section(self, i, report=1):
        return self.skipped(i)

    def parse_html_declaration(self, i):
        return self.skipped(i) if self.rawdata[i:i + 3] == "<![" else super().parse_html_declaration(i)

    def skipped(self, i: int) -> int:
        """Past the ``>`` of a marked section, whatever it holds; −1 if it is cut off."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in ENDS_PARAGRAPH or tag == "body":
            if self.opened["p"]:
                self.close_open({"p"}, {"table", "button", "article", "main", "section", "div"})
            if self.opened["head"]:
                self.close_open({"head"}, ())
        if tag in SIBLINGS:
            self.close_open(*SIBLINGS[tag])
        if tag in VOID:
            return
        out, containers = self.state()
        if tag in CONTAINERS and not out and len(containers) < DEEPEST:
            self.containers += 1
            containers = (*containers, (tag, self.containers))
        self.stack.append((tag, out or self.excludes(tag, attrs, containers), containers))
        self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.opened[tag]:
            self.close_open((tag,), () if tag in BLOCK or tag in EXCLUDED else BLOCK)

    def handle_data(self, data):
        if not self.state()[0]:
            self.text.append(data)

    def close(self):
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigmas and renormalised at the ends."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[at] / np.convolve(np.ones(len(ratios)), kernel)[at]


def threshold(values: np.ndarray) -> float:
    """The cut between two groups of values: midway between their means."""
    cut = float(values.mean())
    for _ in range(50):
        high, low = values[values >= cut], values[values < cut]
        if not len(low) or not len(high):
            break
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty if there is none."""
    html = html or ""
    last = html.rfind("<!--")
    if last >= 0 and html.find("-->", last) < 0 and html.find("</script", last) < 0:
        html = html[:last]  # a comment that the page's end cuts off
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    raw = np.array([len(t) / max(1, n) for t, n, _ in lines])
    ratio = np.maximum(raw, smoothed(raw))
    content = np.flatnonzero(ratio >= threshold(smoothed(raw)))
    region = content_region([lines[i] for i in content])
    if region is not None:
        return "\n".join(t for t, _, containers in lines if region in containers)
    return "\n".join(t for t, _, _ in lines[content[0]:content[-1] + 1])


def content_region(content: list[tuple[str, int, tuple]]) -> tuple | None:
    """The container to keep whole, if one holds enough of the content text."""
    inside: Counter = Counter()
    for text, _, containers in content:
        for c in containers:
            inside[c] += len(text)
    total = sum(len(t) for t, _, _ in content)
    for tag in ("article", "main"):
        # most content first, then the outermost
        best = max((c for c in inside if c[0] == tag), key=lambda c: (inside[c], -c[1]), default=None)
        if best and inside[best] >= MOST * total:
            return best
    # containers are numbered as they open: the last of those that nest is the deepest
    return max((c for c in inside if inside[c] >= NEARLY_ALL * total), key=lambda c: c[1], default=None)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty html, or one without text, gives an empty text.  Ids and
    urls pass through, nulls and repeats included.  White space (``str.split``)
    inside a block becomes one space; ``<br>`` counts as white space.  An empty
    table gives no rows.  Pages are independent, so nothing is shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")
