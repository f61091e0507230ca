"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one to a block element. A line weighs its text
outside links. Tags and class words only change weights: nothing in menus,
footers, forms and the like, a tenth in elements that a class, id or role
calls furniture, and where ``article`` or ``main`` hold most of the text,
``THRESHOLD`` more inside them and a tenth outside. A mark on an element that
holds most of the page's text, such as a form around the whole page, is void.

Weights are summed over sliding windows of ``WINDOW`` lines, once forwards and
once backwards from each line. The text surges at a line where the lesser sum
reaches the threshold (THRESHOLD, or a quarter of the page's highest if that
is less) and dives where it falls below again; a line just outside the text
has one window without text. The stretches between these points are kept if
they have a quarter of the fullest one's text, with all between two of them in
one article, and with the paragraphs and headings next to their ends in the
same element. Of what lies between the points only marked elements go.

Tags are found in one pass and each end tag closes in constant time on
average, so that a page takes time in proportion to its length, malformed
ones included.

Defined results: a null or empty page, or one without text, gives an empty
text; an unclosed paragraph or list item ends at the next block; an unclosed
comment, script or style takes the rest of the page; repeated pages give
repeated rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 3
THRESHOLD = 80
#: What a class word or lying outside the article leaves of a line's weight.
LOWERED = 0.1
#: The share of the fullest stretch that another must have, and of the page's
#: text that an element must exceed for its mark to be void.
KEPT_SHARE, MOST = 0.25, 0.5
#: Elements with less text than this are never taken for the page's body.
BODY_CHARS = 400
STOP = re.compile(r">|=\s*[\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Element names of HTML, words that page authors give to
# furniture, and words that say where or what shape it is.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "canvas", "audio", "video", "button", "select"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar masthead header footer foot copyright legal sidebar side rail aside widget widgets share sharing social related recommended recommendations trending popular comment comments commentlist reply replies respond disqus discussion search searchbox form complementary contentinfo".split())
PLACES = set("area bar block bottom box button buttons col column container group inner item items left link links list outer page panel post posts primary right row secondary section site slot top unit wrap wrapper".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Line(NamedTuple):
    text: str
    free: int  #: characters outside links
    mark: int  #: the innermost mark around it, 0 without
    holder: int  #: the outermost article or main around it, 0 without
    parent: int  #: the block around the line's own block
    tag: str


class Mark:
    """An element that looks like furniture; ``certain`` by its tag."""

    __slots__ = ("certain", "outer", "tag", "free", "articles")

    def __init__(self, certain: bool, outer: int, tag: str):
        self.certain, self.outer, self.tag, self.free, self.articles = certain, outer, tag, 0, False


def marked(attributes: str) -> bool:
    """Whether a class, id or role names furniture: ``ad``, ``share-buttons``,
    but not ``has-sidebar`` or ``entry-header``, which say something else."""
    for groups in ATTRIBUTE.findall(attributes):
        for token in "".join(groups).split():
            words = [w.lower() for w in PART.findall(token)]
            if any(w in MARKS for w in words) and all(w in MARKS or w in PLACES or w.isdigit() for w in words):
                return True
    return False


class Scanner:
    """Finds the ends of tags. What no longer occurs is looked for once."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def tag_end(self, begin: int) -> int:
        """After the tag's ``>``, over values in quotes; 0 if there is none.
        A quote that is never closed is a letter like others."""
        if ">" in self.gone:
            return 0
        at = begin
        while m := STOP.search(self.page, at):
            if m[0] == ">":
                return m.end()
            at = max(m.end(), self.find(m[0][-1], m.end()) + 1)
        return self.find(">", begin) + 1

    def raw_end(self, name: str, at: int) -> int:
        """After the end tag of an element whose text is no text."""
        if name in self.gone:
            return 0
        end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, at)
        if not end:
            self.gone.add(name)
        return end.end() if end else 0


def lines_of(page: str) -> tuple[list[Line], list[Mark]]:
    lines, marks, text = [], [Mark(False, 0, "")], []
    scan, at, copied, free, elements = Scanner(page), 0, 0, 0, 0
    # number, name, mark, holder, number and name of the nearest block, the block around that
    stack = [(0, "", 0, 0, 0, "", 0)]
    opened: dict[str, int] = {}

    def take(raw: str) -> None:
        nonlocal free
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if not opened.get("a"):
                free += len(plain.strip())

    def flush() -> None:
        nonlocal free
        joined = " ".join("".join(text).split())
        if joined:
            _, _, mark, holder, _, tag, parent = stack[-1]
            lines.append(Line(joined, min(free, len(joined)), mark, holder, parent, tag))
            marks[mark].free += lines[-1].free
        text.clear()
        free = 0

    def close(name: str) -> None:
        while True:
            gone = stack.pop()[1]
            opened[gone] -= 1
            if gone == name:
                return

    while (i := page.find("<", at)) >= 0:
        at = i + 1
        after = page[at : at + 1]
        if after in ("!", "?"):
            take(page[copied:i])
            if page.startswith("!--", at):
                end = scan.find("-->", at + 3) + 3 if page[at + 3 : at + 4] != ">" else at + 4
            else:
                end = scan.find(">", at) + 1
            at = copied = end if end > at else len(page)
            continue
        ending = after == "/"
        m = NAME.match(page, at + ending)
        if not m:
            continue
        end = scan.tag_end(m.end())
        if not end:
            continue
        take(page[copied:i])
        at = copied = end
        name, attributes = m[0].lower(), page[m.end() : end - 1]
        if not ending and name in RAW and not attributes.endswith("/"):
            end = scan.raw_end(name, at)
            at = copied = end or (len(page) if name in ("script", "style") else at)
            text.append(" ")
            continue
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":
            text.append(" ")
        if ending:
            if opened.get(name) and name not in ("html", "body"):
                close(name)
            continue
        if name in VOID or attributes.endswith("/") and not block:
            continue
        if block:
            nearest = stack[-1][5]
            if nearest == "p" or nearest in CLOSES.get(name, ()):
                close(nearest)
        _, _, mark, holder, own, _, _ = stack[-1]
        elements += 1
        if name in ("article", "main"):
            holder = holder or elements
            marks[mark].articles = True
        elif block and name not in HEADINGS and name not in ("html", "body"):
            certain = name in FURNITURE or name == "header" and not holder
            if certain or attributes and marked(attributes):
                marks.append(Mark(certain, mark, name))
                mark = len(marks) - 1
        stack.append((elements, name, mark, holder, *((elements, name, own) if block else stack[-1][4:])))
        opened[name] = opened.get(name, 0) + 1
    take(page[copied:])
    flush()
    return lines, marks


def effective(marks: list[Mark]) -> list[float]:
    """What each mark leaves of a line's weight: 0, LOWERED or 1."""
    for m in reversed(marks[1:]):
        marks[m.outer].free += m.free
        marks[m.outer].articles |= m.articles
    left = [1.0]
    for m in marks[1:]:
        most = m.free > MOST * marks[0].free
        body = most and (m.articles or (not m.certain or m.tag == "form") and m.free >= BODY_CHARS)
        left.append(min(left[m.outer], 1.0 if body else 0.0 if m.certain else LOWERED))
    return left


def window_sums(weights: list[float], window: int) -> list[float]:
    """The lesser of the sums over the windows that start and end at each line."""
    n, total = len(weights), [0.0, *accumulate(weights)]
    return [min(total[min(n, i + window)] - total[i], total[i + 1] - total[max(0, i + 1 - window)]) for i in range(n)]


def stretches(values: list[float], least: float) -> list[tuple[int, int]]:
    """(surge, dive) of each run of values that reach ``least``; dive exclusive."""
    found, surge = [], -1
    for i, v in enumerate([*values, -1.0]):
        if v >= least and surge < 0:
            surge = i
        elif v < least and surge >= 0:
            found.append((surge, i))
            surge = -1
    return found


def main_text(page: str, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    lines, marks = lines_of(page)
    left = effective(marks)
    plain = [x.free * left[x.mark] for x in lines]
    held = sum(p for p, x in zip(plain, lines) if x.holder)
    by_article = held > MOST * sum(plain) or not sum(plain) and any(x.holder for x in lines)
    weights = []
    for x, p in zip(lines, plain):
        sure = left[x.mark] == 1
        if by_article:
            weights.append(p + threshold * sure if x.holder else p * LOWERED)
        else:
            weights.append(p + threshold * (sure and p > 0 and x.tag in HEADINGS))
    values = window_sums(weights, window)
    if not any(weights):
        return ""
    found = stretches(values, min(threshold, max(values) / 4) or 1e-9)
    found = found or [(weights.index(max(weights)), weights.index(max(weights)) + 1)]
    sizes = [sum(plain[a:b]) for a, b in found]
    kept = [s for s, n in zip(found, sizes) if n >= KEPT_SHARE * max(sizes)]
    spans: list[list[int]] = []
    for a, b in kept:
        if spans and lines[a].holder and lines[a].holder == lines[spans[-1][1] - 1].holder:
            spans[-1][1] = b
        else:
            spans.append([a, b])

    def beside(i: int, edge: Line) -> bool:
        x = lines[i]
        return x.parent == edge.parent and (left[x.mark] < 1 or x.tag == edge.tag or x.tag == "p" or x.tag in HEADINGS)

    chosen: set[int] = set()
    for a, b in spans:
        first, last = lines[a], lines[b - 1]
        while a > 0 and beside(a - 1, first):
            a -= 1
        while b < len(lines) and beside(b, last):
            b += 1
        chosen.update(range(a, b))
    return "\n".join(lines[i].text for i in sorted(chosen) if left[lines[i].mark] == 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
