"""Main-text extraction from raw HTML.

The standard library's parser streams events; block boundaries cut the page into lines. Each line has
a text-to-tag ratio; the ratios are smoothed with a Gaussian and split in two clusters by a threshold.
What the page's structure says goes into the ratios before they are split: lines of menus, headers,
footers and the like count nothing, lines inside an article or main element many times, and lines that
a class, an id or a form marks as boilerplate a part. The lines of the upper cluster choose the region,
the innermost container that holds them; every block of it is returned, but for marked elements without
any line of the cluster. Time and memory grow with the page's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import lean, modest, table

# Element names by their role in HTML, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset(
    "head title script style noscript template nav footer aside button select option textarea iframe object svg canvas dialog menu".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: An open element of these kinds keeps an end tag or an implied end from reaching farther out.
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar topbar masthead comment comments commentlist disqus replies respond share sharing social copyright disclaimer".split()
)
# Names that mark boilerplate only where the ratios say so too; both kinds together make up longer names.
DOUBTFUL = frozenset("notice notices alert side widget tags posts stories links header footer related recommended recommendations promo promotion toc skip legal box bar wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a text and so never the region.
PARTS = HEADINGS | frozenset("p pre li dt dd tr td th caption figcaption summary hr".split())
ROOTS = frozenset(["", "html", "body"])
#: Elements that group parts of a text.
GROUPS = PARTS | frozenset("ul ol dl table thead tbody tfoot blockquote figure".split())
#: How many times denser the upper cluster has to be than the lower one: else all lines are of one kind.
APART = 2.0
#: Characters, and characters a tag, from which a line is prose however much longer others are.
PROSE, PROSE_RATIO = 80, 20
#: Boilerplate by the element itself; by its class or id or as a form alone; by a name that articles bear too.
SURE, MARKED, MAYBE = 3, 2, 1
#: How many times a line inside an article or main counts, and a marked line; the share of the cluster's text that a region around an article has to hold.
TOLD, UNTOLD, NEARLY = 10.0, 0.1, 0.95
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0


class _Frame:
    """An open element that end tags inside it do not reach beyond, and what is open in it."""

    __slots__ = ("count", "name", "own", "tags")

    def __init__(self, name: str, own: int):
        self.name, self.own, self.tags, self.count = name, own, [], {}


class _Lines(HTMLParser):
    """Cuts a page into lines and notes for each its node, its tags and the length of its links.

    Nodes are block elements and marked ones, in page order; each has its parent, name and kind, and
    whether it or one around it is an article or main. Counts of what is open make each tag's cost constant.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.inside, self.name, self.kind = [-1], [False], [""], [0]
        self.frames = [_Frame("", 0)]
        self.scopes: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags, self.node, self.links, self.linked = 0, 0, 0, 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, max(1, self.tags), self.node, self.linked))
            self.tags = 0
        self.text, self.linked = [], 0
        self.node = self._now()

    def _now(self) -> int:
        frame = self.frames[-1]
        return frame.tags[-1][1] if frame.tags else frame.own

    def _shut(self, name: str) -> None:
        """Closes what is open in the innermost frame, up to and with the last element of the name."""
        frame, cut = self.frames[-1], False
        while frame.tags:
            last, _, own = frame.tags.pop()
            frame.count[last] -= 1
            self.links -= last == "a"
            cut = cut or own
            if last == name:
                break
        if cut:
            self._flush()
        self.node = self._now()

    def _shut_frame(self) -> None:
        frame = self.frames.pop()
        self.links -= frame.count.get("a", 0)
        self.scopes[frame.name] -= 1

    def _kind_of(self, tag: str, attrs: dict) -> int:
        if tag in SKIPPED:
            return SURE
        if tag == "header":
            return 0 if self.inside[self._now()] else SURE
        if (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return SURE
        if tag in ("html", "body", "article", "main"):
            return 0
        if tag == "form":
            return MARKED
        found = 0
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            parts = [x for x in re.split("[-_]+", name) if x]
            if parts and all(x in BOILERPLATE or x in DOUBTFUL for x in parts):
                found = max(found, MARKED if any(x in BOILERPLATE for x in parts) else MAYBE)
        return found

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if closes := CLOSES.get(tag):
            frame = self.frames[-1]
            if any(frame.count.get(x) for x in closes):
                while frame.tags and frame.tags[-1][0] not in closes:
                    self._shut(frame.tags[-1][0])
                self._shut(frame.tags[-1][0])
            elif frame.name in closes:
                self._shut_frame()
                self._flush()
        named, above = dict(attrs), self._now()
        kind = self._kind_of(tag, named)
        own = tag in BLOCK or (kind > 0 and self.kind[above] != SURE)
        if own:
            self._flush()
            self.parent.append(above)
            self.name.append(tag)
            self.kind.append(SURE if self.kind[above] == SURE else kind)
            semantic = tag in ("article", "main") or (named.get("role") or "").lower() in ("main", "article") or named.get("itemprop") == "articleBody"
            self.inside.append(semantic or self.inside[above])
            above = self.node = len(self.parent) - 1
        if tag in SCOPES:
            self.frames.append(_Frame(tag, above))
            self.scopes[tag] = self.scopes.get(tag, 0) + 1
        else:
            frame = self.frames[-1]
            frame.tags.append((tag, above, own))
            frame.count[tag] = frame.count.get(tag, 0) + 1
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in SCOPES:
            if self.scopes.get(tag):
                self._flush()
                while self.frames[-1].name != tag:
                    self._shut_frame()
                self._shut_frame()
                self.node = self._now()
        elif self.frames[-1].count.get(tag):
            self._shut(tag)

    def handle_data(self, data):
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian; weights beyond the ends are left out."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return over / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Where two clusters part: the middle of their means, moved until it rests; 0 where they lie close together."""
    at = float(values.mean())
    low, high = values[values < at], values[values >= at]
    for _ in range(30):
        if not len(low) or not len(high):
            return 0.0
        moved = float(low.mean() + high.mean()) / 2
        if abs(moved - at) < 1e-9:
            break
        at = moved
        low, high = values[values < at], values[values >= at]
    return at if not len(low) or not len(high) or high.mean() >= APART * low.mean() else 0.0


def _dense(page: _Lines, sure: list[bool]) -> list[int]:
    """The lines of the upper cluster, and all as dense as prose is; all that are not boilerplate by their element if there is none.

    Lines of boilerplate elements and lines that are mostly links are never in it. A run of the cluster starts
    and ends with a line that is as dense without smoothing; others only lie in between.
    """
    lines = page.lines
    ratios = np.array([0.0 if off else max(0, len(text) - linked) / tags for (text, tags, _, linked), off in zip(lines, sure, strict=True)])
    counts = _evidence(page)
    smooth, ratios = smoothed(ratios) * counts, ratios * counts
    at = threshold(smooth)
    upper = smooth >= at
    n, order = len(lines), np.arange(len(lines))
    own = upper & (ratios >= at)
    before = np.maximum.accumulate(np.where(own, order, -1))  # the nearest such line before and after, and lines out of the cluster
    after = np.minimum.accumulate(np.where(own, order, n)[::-1])[::-1]
    gap_before = np.maximum.accumulate(np.where(upper, -1, order))
    gap_after = np.minimum.accumulate(np.where(upper, n, order)[::-1])[::-1]
    upper &= (before > gap_before) & (after < gap_after)
    able = [not off and 2 * linked <= len(text) for (text, _, _, linked), off in zip(lines, sure, strict=True)]
    most = max((c for c, ok in zip(counts, able, strict=True) if ok), default=0.0)
    found = {i for i, (text, tags, _, _) in enumerate(lines) if able[i] and (upper[i] or (counts[i] >= most and len(text) >= max(PROSE, PROSE_RATIO * tags)))}
    if not any(counts[i] >= TOLD for i in found):  # an article that is too short to be seen
        found |= {i for i, c in enumerate(counts) if able[i] and c >= TOLD}
    return sorted(found) or [i for i, off in enumerate(sure) if not off]


def _evidence(page: _Lines) -> np.ndarray:
    """How many times each line counts, by where it stands."""
    marks = [0] * len(page.parent)
    for n in range(1, len(marks)):
        marks[n] = min(marks[page.parent[n]] + (page.kind[n] == MARKED), 9)
    return np.array([(TOLD if page.inside[x[2]] else 1.0) * UNTOLD ** marks[x[2]] for x in page.lines])


def _below(page: _Lines, which: list[int], value) -> list[int]:
    """For each node the sum of ``value`` over the lines ``which`` below it; a node's parent comes before it."""
    out = [0] * len(page.parent)
    for i in which:
        out[page.lines[i][2]] += value(i)
    for n in range(len(out) - 1, 0, -1):
        out[page.parent[n]] += out[n]
    return out


def _downward(page: _Lines, marks) -> list[bool]:
    """Which nodes are among the marked ones or below one."""
    out = [False] * len(page.parent)
    for n in range(len(out)):
        out[n] = n in marks or (n > 0 and out[page.parent[n]])
    return out


def _skipped(page: _Lines, sure: list[bool], content: list[int]) -> list[bool]:
    """Which lines are boilerplate: those of such elements, and those below a marked node that has no line of the cluster."""
    dense = _below(page, content, lambda i: 1)
    off = _downward(page, {n for n, k in enumerate(page.kind) if k in (MARKED, MAYBE) and not dense[n]})
    return [a or off[x[2]] for a, x in zip(sure, page.lines, strict=True)]


def _rounded(page: _Lines, skip: list[bool], region: int, content: list[int]) -> tuple[int, int]:
    """The region made whole: its first line and the one after its last.

    It grows to the article it lies in; else to each container around it whose other lines are headings,
    paragraphs, items and the like of its own, not mostly links; and by such lines right beside it.
    """
    lines, n = page.lines, len(page.lines)
    holder = [0] * len(page.parent)
    article = [-1] * len(page.parent)
    for k in range(1, len(holder)):
        up = page.parent[k]
        holder[k] = holder[up] if page.name[k] in GROUPS else k
        article[k] = k if page.name[k] == "article" else article[up]
    flows = [not skip[i] and page.name[x[2]] in PARTS and 2 * x[3] < len(x[0]) for i, x in enumerate(lines)]
    left = [i for i in range(n) if not skip[i]]
    every = _below(page, left, lambda i: 1)
    own = [0] * len(holder)
    for i in left:
        own[holder[lines[i][2]]] += flows[i]
    if article[region] >= 0:
        region = article[region]
    else:
        while region and page.name[region] not in ROOTS and not (page.inside[region] and not page.inside[page.parent[region]]):
            up = holder[page.parent[region]]
            if page.name[up] in ROOTS or every[up] - every[region] != own[up]:
                break
            region = up
    inside = _downward(page, {region})
    if page.name[region] in ROOTS:
        first, last, beside = content[0], content[-1] + 1, {holder[lines[i][2]] for i in (content[0], content[-1])}
    else:
        within = [i for i in left if inside[lines[i][2]]]
        first, last, beside = within[0], within[-1] + 1, set() if page.inside[region] else {holder[page.parent[region]]}
    while first and flows[first - 1] and (holder[lines[first - 1][2]] in beside or (beside and page.name[lines[first - 1][2]] in HEADINGS)):
        first -= 1
    while last < n and flows[last] and holder[lines[last][2]] in beside:
        last += 1
    return first, last


def blocks(html: str) -> list[str]:
    """The blocks of the main text in page order."""
    page = _Lines()
    page.feed(html)
    page.finish()
    lines = page.lines
    sure = [page.kind[x[2]] == SURE for x in lines]
    if all(sure):
        return []
    content = _dense(page, sure)
    skip = _skipped(page, sure, content)
    weight = _below(page, content, lambda i: len(lines[i][0]))
    need = weight[0] * NEARLY if any(page.inside[lines[i][2]] for i in content) else weight[0]
    region = max(n for n, w in enumerate(weight) if w >= need and page.name[n] not in PARTS)
    first, last = _rounded(page, skip, region, content)
    return [lines[i][0] for i in range(first, last) if not skip[i]]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The pages with ``html_col`` replaced by ``text_col``, the main text.

    Blocks are joined by an empty line; character references are decoded and white space inside a
    block (also a line break) becomes one space. Null, empty or text-free html gives an empty text.
    Nothing is cut short, also not from very long pages. Repeated rows and other columns are kept; an
    input column named ``text_col`` is replaced.
    """
    base = pages.drop(text_col) if text_col != html_col else pages
    rest = [f for f in base.schema.fields if f.name != html_col]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(blocks(x)) if x else "" for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), text_col])

    return modest(base).mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7_html_extraction."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
