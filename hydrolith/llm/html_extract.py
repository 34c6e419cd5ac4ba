"""The main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of HTML: elements whose content isn't markup, that have none, that stand within a line, and parts of a page.
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img area map picture".split())
OUTSIDE = frozenset("nav footer aside form button select option fieldset noscript template svg canvas object audio video dialog menu head datalist".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that mark what isn't the article: as a part of a name outside an article, as a whole one within.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer comment comments commentlist reply replies disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "share sharing social related widget pagination pager login signup search copyright toolbar masthead alert".split()
)
HEADERS = frozenset("header masthead topbar".split())
REPLIES = frozenset("comment comments commentlist reply replies disqus".split())
PART = re.compile(r"[^a-z0-9]+")


class Line:
    __slots__ = ("text", "inside", "link")

    def __init__(self, text: str, inside: bool, link: int) -> None:
        self.text, self.inside, self.link = text, inside, link


def _marks(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of an article."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and value:
            parts = set(value.split() if inside else PART.split(value))
            if parts & REPLIES or tag not in ARTICLE and (parts & MARKED or not inside and parts & HEADERS):
                return True
    return False


def lines_of(page: str) -> tuple[list[Line], bool]:
    """Lines of text between block elements, in page order, and whether the page marks its article.

    Lines of menus and the like are there, empty: they part what stands around them.
    """
    lines: list[Line] = []
    stack: list[str] = []
    out_at: list[int] = []  # depth of the elements that aren't of the article
    articles = links = 0
    marked = False
    buffer: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        text = " ".join(html.unescape("".join(buffer)).split())
        if text or buffer:
            lines.append(Line(text if not out_at else "", articles > 0, link))
        buffer.clear()
        link = 0

    def close(depth: int) -> None:
        nonlocal articles, links
        while len(stack) > depth:
            tag = stack.pop()
            articles -= tag in ARTICLE
            links -= tag == "a"
            if out_at and out_at[-1] == len(stack):
                out_at.pop()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            buffer.append(piece)
            link += len(piece) if links else 0
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == tag), -1)
            if depth >= 0:
                if any(d >= depth for d in out_at) and tag in INLINE:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ARTICLE:
            continue
        if tag in ARTICLE and out_at and "article" not in stack and "main" not in stack and all(stack[d] in OUTSIDE for d in out_at):
            close(min(out_at))  # a menu or the like that was never closed
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and tag in stack:
            i = len(stack) - 1 - stack[::-1].index(tag)
            if tag == "p" or not any(x in ("ul", "ol", "table", "dl") for x in stack[i + 1 :]):
                if tag != "p" or not any(x not in INLINE for x in stack[i + 1 :]):
                    close(i)
        if _marks(tag, attributes, articles > 0):
            if tag in INLINE:
                flush()
            out_at.append(len(stack))
        stack.append(tag)
        articles += tag in ARTICLE
        marked |= tag in ARTICLE and not out_at
        links += tag == "a"
    flush()
    return lines, marked


def weights_of(lines: list[Line], marked: bool) -> np.ndarray:
    """Characters that each line adds to the distribution: on a page that marks its article those within it, else those outside links."""
    return np.array([len(x.text) * x.inside if marked else max(len(x.text) - x.link, 0) for x in lines], np.int64)


def spans_of(weights: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """Where the distribution surges and dives: (first, end) of the lines between.

    Weights are summed over windows of ``window`` lines from each on. A span has a sum above ``surge``, or above half
    the highest sum of the page if that is less; it begins where the sums rise from none and ends where they dive to
    none, so the lines that lead up to a surge are part of it.
    """
    if not weights.any():
        return []
    sums = np.convolve(np.concatenate([weights, np.zeros(window - 1, np.int64)]), np.ones(window, np.int64), "valid")
    level = min(surge, sums.max() / 2)
    full = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(full[1:] != full[:-1])
    return [(a, z) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if sums[a:z].max() > level]


def extract(page: str | None, window: int = 3, surge: int = 86) -> str:
    """The main text of a page: its lines between the surges and dives of their distribution, joined by line feeds.

    Stripping comes first: scripts, menus, forms and what names itself no article leave lines without text, and on a
    page that marks its article (article or main) so does what stands outside, while within an article nothing
    is left in their place. Then text is summed over sliding windows of lines, and lines between a surge and a dive are
    kept whole, but for lines that are nothing but links where no article is marked.
    """
    lines, marked = lines_of(page or "")
    if marked:
        lines = [x for x in lines if x.text or not x.inside]
    weights = weights_of(lines, marked)
    return "\n".join(lines[i].text for a, z in spans_of(weights, window, surge) for i in range(a, z) if weights[i])


def main_texts(pages: DataFrame, window: int = 3, surge: int = 86) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html), without a shuffle.

    A null or empty page has an empty text, as has one without main text. Character references are decoded, white
    space inside a line becomes one space, and n_chars counts code points. Unclosed elements, comments and quotes
    end where the page ends. Repeated rows and null ids are kept. Other columns are not looked at. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), window, surge) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
