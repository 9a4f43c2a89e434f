"""Main text of HTML pages from the standard library's parser events.

The parser's events cut a page into lines, one for each block. A line's
text-to-tag ratio is its characters outside links over its tags. The ratios'
logarithms are smoothed by a Gaussian over neighbouring lines and split by the
threshold between their two cluster means: lines above it are content. Of all
elements that may hold a text, the region is the one whose lines agree best
with the content lines (the harmonic mean of precision and recall, in
characters); being an article is a prior that multiplies this. Where articles
hold text, content is theirs alone. In an article's region every line is
returned, links or not; in any other those from the first line above the
threshold by itself to the last, with the headings right before, and what lies
in one container with such lines, but for lists of links below the threshold or
at its ends: several links in a line, lines of links in a row, a link of one
word.

Lines inside menus, headers, footers, side bars, notices, adverts, forms,
comments, scripts and styles are set aside by element, role, class and id. A
form, or an element with such a word in only a part of its class or id, yields
to an article inside and to most of the page's text; and where everything is set
aside, what holds prose yields, so that no name empties a page.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import small_batches

_SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Set aside, whatever is inside.
HARD = frozenset("applet audio aside button canvas dialog embed footer head iframe input map menu noscript object script select style svg template textarea title video".split())
#: Verdicts that yield to most of the page's text.
YIELDING = ("form", "weak")
#: Set aside, unless an article or main element begins inside.
SOFT = frozenset("form header nav".split())
SOFT_ROLES = frozenset("banner form navigation search".split())
HARD_ROLES = frozenset("alert alertdialog complementary contentinfo dialog menu menubar tablist toolbar".split())
HARD_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr menu modal navbar newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
SOFT_NAMES = frozenset("banner header masthead nav navigation topbar".split())
#: Elements that a start tag closes if they are open in the same container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside blockquote body dd div dl footer form header html li main nav ol section table td th tr ul".split())

#: Elements that may be the region of the text.
REGIONS = frozenset("article body center div html main section td".split())

#: What being an article adds to an element's agreement with the content lines.
PRIOR = 1.3
#: Characters outside links that make a line prose.
PROSE = 80
#: And that make an article one with a text of its own.
TEXT = 40
#: Elements without a text of their own, whatever they hold.
SILENT = frozenset("applet audio button canvas dialog embed iframe input map menu noscript object script select style svg template textarea title video".split())

_MARK = re.compile("<[a-zA-Z/!?]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def known(words: list[str]) -> list[str]:
    """The words of a name, two that make up a known one together as one (side-bar)."""
    out: list[str] = []
    for w in words:
        if out and (out[-1] + w in HARD_NAMES or out[-1] + w in SOFT_NAMES):
            out[-1] += w
        else:
            out.append(w)
    return out


class Line:
    """A block's text, its tags, its links and the characters in them, and the innermost open element."""

    __slots__ = ("text", "tags", "anchors", "linked", "node", "heading")

    def __init__(self, text: str, tags: int, anchors: int, linked: int, node: int, heading: bool):
        self.text, self.tags, self.anchors, self.linked, self.node, self.heading = text, tags, anchors, linked, node, heading

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.linked)


class Blocks(HTMLParser):
    """Parser events to lines and a tree of elements: ``names``, ``parents`` and ``verdicts`` (hard, soft, form, weak, article or empty), parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.verdicts = [""], [-1], [""]
        self.open: list[int] = []
        self.counts: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.links = self.anchors = self.linked = self.headings = 0
        self.tags = 1

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.anchors, self.linked, self.open[-1] if self.open else 0, self.headings > 0))
                self.tags = 1
            self.parts.clear()
            self.linked = self.anchors = 0

    def cut(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        for node in self.open[at:]:
            name = self.names[node]
            self.counts[name] -= 1
            self.links -= name == "a"
            self.headings -= name in HEADINGS
        del self.open[at:]

    @staticmethod
    def verdict(name: str, attrs: list) -> str:
        if name in HARD:
            return "hard"
        found, a = "", {k: v or "" for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return "hard"
        if name not in ("html", "body", "main"):
            role = a.get("role", "").lower()
            if role in HARD_ROLES:
                return "hard"
            if role in SOFT_ROLES:
                found = "form" if role == "form" else "soft"
            for one in f"{a.get('class', '')} {a.get('id', '')}".split():
                words = known([x.lower() for x in _NAME.findall(one)])
                if all(x in HARD_NAMES or x in SOFT_NAMES for x in words):
                    if not HARD_NAMES.isdisjoint(words):
                        return "hard"
                    found = "soft" if words else found
                elif not found and not (HARD_NAMES.isdisjoint(words) and SOFT_NAMES.isdisjoint(words)):
                    found = "weak"
        if name in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody":
            return "article"
        return "form" if name == "form" and found != "soft" else "soft" if name in SOFT else found

    def close_to(self, names: tuple[str, ...]) -> None:
        if not any(self.counts[x] for x in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.names[self.open[i]]
            if name in names:
                self.flush()
                self.cut(i)
                return
            if name in CONTAINERS:
                return

    def handle_starttag(self, name: str, attrs: list) -> None:
        self.tags += 1
        if name == "br":
            self.parts.append(" ")
            return
        if name in BLOCKS:
            self.flush()
            if name not in IN_HEAD and name != "head" and self.counts["head"] > 0:
                self.cut(next(i for i, x in enumerate(self.open) if self.names[x] == "head"))
            if name in CONTAINERS or name in HEADINGS or name in CLOSES:
                for up in ("p",) if name not in CLOSES else ("p", *CLOSES[name]):
                    self.close_to((up,))
        if name in VOID:
            return
        verdict = self.verdict(name, attrs)
        if verdict and self.parts:
            self.flush()
        self.names.append(name)
        self.parents.append(self.open[-1] if self.open else 0)
        self.verdicts.append(verdict)
        self.open.append(len(self.names) - 1)
        self.counts[name] += 1
        self.links += name == "a"
        self.anchors += name == "a"
        self.headings += name in HEADINGS

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)

    def handle_endtag(self, name: str) -> None:
        self.tags += 1
        if name in BLOCKS:
            self.flush()
        if self.counts[name] <= 0:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.names[self.open[i]] == name:
                if any(self.verdicts[x] for x in self.open[i:]):
                    self.flush()
                self.cut(i)
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data)

    def end(self) -> None:
        """The input's end. An unclosed tag or comment that the parser still waits for hides the rest, as in a browser."""
        if not _MARK.match(self.rawdata):
            self.close()
        self.flush()

    def container(self, node: int) -> int:
        """The innermost container of an element, itself included."""
        while node and self.names[node] not in CONTAINERS:
            node = self.parents[node]
        return node

    # over the tree, each in one pass

    def sums(self, values: dict[int, int]) -> list[int]:
        """For each element the sum of the values in it, by innermost element."""
        out = [0] * len(self.names)
        for node, v in values.items():
            out[node] += v
        for node in range(len(out) - 1, 0, -1):
            out[self.parents[node]] += out[node]
        return out

    def judged(self, exempt=frozenset()) -> list[tuple[str, int | None]]:
        """For each element whether its lines are set aside (``hard``, ``soft``, ``heading``: soft but for headings, or not) and the article they are in; verdicts of ``exempt`` elements do not count."""
        out: list[tuple[str, int | None]] = [("", None)]
        for node in range(1, len(self.names)):
            aside, home = out[self.parents[node]]
            verdict = self.verdicts[node] if node not in exempt else ""
            if verdict == "hard":
                aside = "hard"
            elif verdict == "article":
                if aside != "hard":
                    aside, home = "", node if home is None else home
            elif verdict and not aside:
                aside = "heading" if home is not None and self.names[node] == "header" else "soft"
            out.append((aside, home))
        return out


def added(pairs) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, v in pairs:
        out[k] = out.get(k, 0) + v
    return out


def smoothed(values: list[float], sigma: float) -> list[float]:
    radius = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[low - i + radius : high - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def split_value(values: list[float]) -> float:
    """The middle between the two cluster means of the values; the least value if the means are near, a page of one kind of lines."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(under) / len(under) if under else low, sum(over) / len(over) if over else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low > 0.7 else min(values)


def aside(x: Line, judged: list) -> str:
    state = judged[x.node][0]
    return ("" if x.heading else "soft") if state == "heading" else state


def yielded(page: Blocks, judged: list) -> set[int]:
    """Forms and elements with a word in a part of their name that hold most of the text outside links, unless an article with text lies elsewhere."""
    soft = [False]
    for node in range(1, len(page.names)):
        soft.append(soft[page.parents[node]] or page.verdicts[node] == "soft")
    open_ = [x for x in page.lines if not (state := aside(x, judged)) or state != "hard" and not soft[x.node]]
    total, weight = sum(x.own for x in open_), page.sums(added((x.node, x.own) for x in open_))
    homes = {judged[x.node][1] for x in page.lines if not aside(x, judged)} - {None}
    return {n for n, v in enumerate(page.verdicts) if v in YIELDING and 2 * weight[n] > total and homes <= {judged[n][1]}}


def prose(page: Blocks) -> set[int]:
    """Elements that are set aside by a name or role, or as a menu, header, footer or side bar, and hold prose: a line of ``PROSE`` characters outside links."""
    held = page.sums(added((x.node, 1) for x in page.lines if x.own >= PROSE and 2 * x.linked < len(x.text)))
    return {n for n, v in enumerate(page.verdicts) if v and v != "article" and held[n] and page.names[n] not in SILENT}


def main_text(html: str | None, sigma: float = 1.5, by_ratio: bool = True) -> str:
    """The page's main text, its blocks joined by line feeds; empty for null, empty and textless pages.

    With ``by_ratio`` False every line counts as content: what is left is the prior alone.
    """
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.end()
    judged = page.judged()
    exempt = yielded(page, judged)
    if all(aside(x, judged) for x in page.lines):
        # everything is set aside: no form counts, nor, if there is none, a part of a name; then nothing that holds prose
        of = lambda kind: {n for n, v in enumerate(page.verdicts) if v == kind}
        exempt |= of("form") or (set() if exempt else of("weak"))
        if all(aside(x, page.judged(exempt)) for x in page.lines):
            exempt |= prose(page)
    judged = page.judged(exempt) if exempt else judged
    lines = [x for x in page.lines if not aside(x, judged)]
    if not lines:
        return ""
    plain = [math.log1p(x.own / x.tags) for x in lines]
    ratio = smoothed(plain, sigma)
    cut, strong = (split_value(ratio), split_value(plain)) if by_ratio else (min(ratio), min(plain))
    above = [r >= cut for r in ratio]
    links = [2 * x.linked > len(x.text) for x in lines]
    content = [i for i in range(len(lines)) if above[i] and not links[i]] or list(range(len(lines)))
    homed = [judged[x.node][1] is not None and not links[i] for i, x in enumerate(lines)]
    if any(h and x.own >= TEXT for h, x in zip(homed, lines, strict=True)):
        content = [i for i in content if homed[i]] or [i for i, h in enumerate(homed) if h]
    alone = [links[i] and not x.heading for i, x in enumerate(lines)]
    lists = [a and (lines[i].anchors > 1 or " " not in lines[i].text or any(alone[k] for k in (i - 1, i + 1) if 0 <= k < len(lines))) for i, a in enumerate(alone)]
    chosen = set(content)
    # lines that only their neighbours raise do not speak for an element
    heavy = [i for i in content if plain[i] >= strong] or content
    found = page.sums(added((lines[i].node, len(lines[i].text)) for i in heavy))
    size = page.sums(added((x.node, len(x.text)) for x in lines))
    best, region, article = -1.0, 0, False
    for n, name in enumerate(page.names):
        is_article = page.verdicts[n] == "article" and n not in exempt
        if found[n] and (is_article or not n or name in REGIONS):
            score = 2 * found[n] / (size[n] + found[0]) * (PRIOR if is_article else 1.0)
            # of equals the innermost, which comes later
            if score >= best:
                best, region, article = score, n, is_article
    inside = [False] * len(page.names)
    for n in range(len(inside)):
        inside[n] = n == region or n > 0 and inside[page.parents[n]]
    at = [i for i, x in enumerate(lines) if inside[x.node] and (article or above[i] or not lists[i])]
    if not article:
        # the ends: lines that only their neighbours raise go, but for headings right before and what lies beside lines that speak for the element
        beside = {page.container(lines[i].node) for i in heavy}
        held = [k for k, i in enumerate(at) if plain[i] >= strong and i in chosen]
        first, last = (held[0], held[-1]) if held else (0, len(at) - 1)
        while first and lines[at[first - 1]].heading:
            first -= 1
        at = [i for k, i in enumerate(at) if first <= k <= last or not lists[i] and page.container(lines[i].node) in beside]
        # nor do lists of links at the region's ends belong to the text
        while at and lists[at[0]]:
            at.pop(0)
        while at and lists[at[-1]]:
            at.pop()
    return "\n".join(lines[i].text for i in at)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    White space inside a block becomes one space, blocks are joined by one line
    feed and character references are decoded. Null, empty and textless pages
    give an empty text; broken markup is read as the parser reads it; nothing is
    cut. Null ids and addresses stay null, repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, _SCHEMA)
