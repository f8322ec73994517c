"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that hold no article text wherever they stand
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select textarea menu dialog iframe object "
    "svg math canvas audio video".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu".split())
#: words in a class or id that name page furniture
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "share sharing social related recommended comment comments disqus reply replies respond widget toolbar pagination "
    "pager copyright legal login signup search footer masthead skip".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: words in a class or id that name the text itself
BODY_WORDS = frozenset("article content entry post story body main text".split())
#: reasons that a page may give for an element that holds its text: a form around everything, a class with a listed word
SOFT = frozenset(["form", "furniture", "header"])
LISTS = ("ul", "ol", "menu", "dir")
NAME = re.compile(r"[A-Za-z0-9]+")


class PageEvents(HTMLParser):
    """Turns events into lines: a line is the text between two block boundaries.

    Each line has its text, the number of tags seen since the last one, the share of its text in links, and the element
    that encloses it. ``settle`` decides which elements are furniture. Every event takes constant time, taken over the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, number of the enclosing element afterwards
        self.places: dict[str, list[int]] = defaultdict(list)  # by tag, its places in the stack
        self.blocks: list[int] = []  # places of the blocks in the stack
        # by element number; 0 is the page
        self.parent, self.kind, self.why, self.tag = [-1], [""], [""], [""]
        self.in_region, self.closed = [False], [False]
        self.dead = [""]
        self.here = 0
        self.lines: list[tuple[str, int, float, int]] = []
        self.buffer: list[str] = []
        self.tags = self.linked = self.in_link = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append((text, self.tags, self.linked / len(text), self.here))
                self.tags = 0
            self.buffer.clear()
        self.linked = 0

    def _push(self, tag: str) -> None:
        self.places[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, self.here))

    def _pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        self.here = self.stack[-1][1] if self.stack else 0

    def _place(self, *tags: str) -> int:
        """The place of the innermost open element with one of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _close_open_p(self) -> None:
        at = self._place("p")
        if at >= 0 and self.blocks[-1] == at:
            self._pop_to(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self._close_open_p()
        elif tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag == "li":
            at = self._place("li")
            if at > self._place(*LISTS):
                self._pop_to(at)
        elif tag == "body":
            self._pop_to(self._place("html") + 1)
        elif tag == "a":
            self.in_link = 1
        region, why = "", ""
        if tag in NEVER:
            why = tag
        elif attrs:
            region, why = self._judge(tag, attrs)
        if tag in ("article", "main"):
            region = tag
        elif tag == "header" and not self.in_region[self.here]:
            why = why or tag
        if region or why or tag in BLOCKS:
            self.parent.append(self.here)
            self.kind.append(region)
            self.why.append(why)
            self.tag.append(tag)
            self.in_region.append(bool(region) or self.in_region[self.here])
            self.closed.append(False)
            self.here = len(self.parent) - 1
        self._push(tag)

    def settle(self) -> None:
        """Decide which elements are furniture: those with a reason of their own and all that they hold.

        An article or main element is not, if the element that makes it furniture was never closed. An element with a
        soft reason is not, if it holds most of the page's text outside links and, when only its class speaks against
        it, an article, a main element or a first heading.
        """
        pardoned: set[int] = set()
        if any(w in SOFT for w in self.why):
            self._spread_death({e for e, w in enumerate(self.why) if w in SOFT})
            text, marks = [0] * len(self.parent), [0] * len(self.parent)
            for t, _, links, at in self.lines:
                if not self.dead[at] and links < 0.8:
                    text[at] += len(t)
            for e in range(len(self.parent) - 1, 0, -1):
                marks[e] += self.tag[e] in ("article", "main", "h1")
                text[self.parent[e]] += text[e]
                marks[self.parent[e]] += marks[e]
            pardoned = {e for e, w in enumerate(self.why)
                        if w in SOFT and 2 * text[e] > text[0] and (w == "form" or marks[e] > (self.tag[e] == "h1"))}
        self._spread_death(pardoned)

    def _spread_death(self, pardoned: set[int]) -> None:
        self.dead = [""] * len(self.parent)
        cause = [0] * len(self.parent)
        for e in range(1, len(self.parent)):  # an element has a higher number than the one around it
            around = self.parent[e]
            own = "" if e in pardoned else self.why[e]
            dead = self.dead[around]
            if dead and dead != "comments" and not own and self.tag[e] in ("article", "main") and not self.closed[cause[around]]:
                dead = ""
            self.dead[e], cause[e] = dead or own, cause[around] if dead else e

    def _judge(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, str]:
        region, names = "", []
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                names += [w.lower() for w in NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))]
            elif name == "role":
                if value.strip().lower() in NEVER_ROLES:
                    return "", "role"
                if value.strip().lower() in ("main", "article"):
                    region = value.strip().lower()
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return "", "hidden"
        if tag in ("html", "body"):
            return "", ""
        words = set(names)
        if words & COMMENTS:
            return "", "comments"
        if words & FURNITURE and not words & BODY_WORDS:
            return "", "furniture"
        if "header" in words and not words & BODY_WORDS and not self.in_region[self.here]:
            return "", "header"
        return region, ""

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.flush()
        if tag == "a":
            self.in_link = 0
        at = self._place(tag)
        if at < 0 or not block and self.blocks and self.blocks[-1] > at:
            return
        self.closed[self.stack[at][1]] = True
        self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.tag[self.here] in ("script", "style"):
            return
        self.buffer.append(data)
        if self.in_link:
            self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel of radius 2 sigma, renormalised at the ends."""
    radius = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = slice(radius, radius + len(values))
    return np.convolve(values, kernel)[full] / np.convolve(np.ones(len(values)), kernel)[full]


def main_text(html: str | None) -> str:
    """The article of a page as blocks joined by newlines; empty when there is none.

    Lines in furniture count as having no text. The ratio of text to tags of each line is smoothed along the page and
    cut at its standard deviation; the lines above form the content cluster. The region is the article
    element with most of the cluster's text, further ones with at least half as much, and those beside it that have
    some of it; or the main elements, judged alike, where they hold more than twice as much. Without either it is the page, from which lists of links outside the cluster are left out. All
    lines of the region that are not furniture are the text.
    """
    if not html:
        return ""
    page = PageEvents()
    try:
        page.feed(html)
        page.close()
    except AssertionError:  # the parser rejects unknown marked sections
        page = PageEvents()
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    page.flush()
    if not page.lines:
        return ""
    page.settle()
    lines = [(t, n, bool(page.dead[at]), links, at) for t, n, links, at in page.lines]
    ratio = smooth(np.array([0.0 if dead else len(t) / max(1, n) for t, n, dead, _, _ in lines]))
    cluster = ratio >= min(ratio.std(), ratio.max())
    if all(dead for _, _, dead, _, _ in lines):
        return ""
    spread = [0] * len(page.parent)  # text of the cluster that an element holds
    holds = [False] * len(page.parent)
    for (text, _, dead, links, at), chosen in zip(lines, cluster.tolist(), strict=True):
        if not dead:
            holds[at] = True
            spread[at] += len(text) if chosen and links < 0.8 else 0
    for e in range(len(page.parent) - 1, 0, -1):
        spread[page.parent[e]] += spread[e]
        holds[page.parent[e]] |= holds[e]

    def regions(kind: str) -> tuple[int, set[int]]:
        found = [e for e, k in enumerate(page.kind) if k == kind and holds[e]]
        best = max((spread[e] for e in found), default=0)
        # an article may be written as several sections
        beside = {page.parent[e] for e in found if spread[e] == best}
        region = {e for e in found if 2 * spread[e] >= best or spread[e] and page.parent[e] in beside}
        inside = _under(page, region)
        outer = [e for e in region if not inside[page.parent[e]]]
        return sum(spread[e] for e in outer), region

    (held, region), (held_by_main, mains) = regions("article"), regions("main")
    if not region or held_by_main > 2 * held:
        region = mains
    if not region:
        lists = _link_lists(page, lines, cluster.tolist())
        return "\n".join(t for i, (t, _, dead, _, _) in enumerate(lines) if not dead and i not in lists)
    within = _under(page, region)
    return "\n".join(t for t, _, dead, _, at in lines if not dead and within[at])


def _under(page: PageEvents, roots: set[int]) -> list[bool]:
    """For each element whether it is one of these or inside one."""
    found = [0 in roots]
    for e in range(1, len(page.parent)):
        found.append(e in roots or found[page.parent[e]])
    return found


def _link_lists(page: PageEvents, lines: list[tuple[str, int, bool, float, int]], cluster: list[bool]) -> set[int]:
    """Numbers of the lines in lists of links outside the text: runs of two lines or more that are mostly links, before
    the first or after the last line of the cluster, outside the smallest element that holds the whole cluster, and not
    led by a heading after the text, as sources are."""
    held = [i for i, (_, _, dead, links, _) in enumerate(lines) if cluster[i] and not dead and links < 0.8]
    if not held:
        return set()
    home = _common_element(page, {lines[i][4] for i in held})
    narrow = page.tag[home] not in ("", "html", "body")

    inside = _under(page, {home})
    out: set[int] = set()
    run: list[int] = []
    before = None
    for i, (_, _, dead, links, at) in enumerate([*lines, ("", 0, False, 0.0, 0)]):
        if dead:
            continue
        if links >= 0.8 and not held[0] < i < held[-1] and not (narrow and inside[at]):
            run.append(i)
            continue
        led = before is not None and run and run[0] > held[-1] and page.tag[lines[before][4]] in HEADINGS
        if len(run) > 1 and not led:
            out.update(run)
        run, before = [], i
    return out


def _common_element(page: PageEvents, elements: set[int]) -> int:
    """The smallest element that holds all of these."""
    left = [-e for e in elements]
    heapify(left)
    while True:
        last = -heappop(left)  # an element has a higher number than the one around it
        while left and left[0] == -last:
            heappop(left)
        if not left:
            return last
        heappush(left, -page.parent[last])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``; text is empty where a page has none, is null or empty.

    Pages are independent, so null ids, ties and repeated rows pass through, an empty table gives no rows, and other
    columns are not looked at. A page is parsed as a stream of events in one task; nothing is shuffled.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(
        _extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(read(spark, sf, "pages"))
