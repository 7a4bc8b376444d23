"""Main text of web pages by line-block distribution.

Markup is stripped into one line for each block of text. What the markup itself calls a menu, header, footer, form, advert, comment
and the like leaves empty lines, and so do the edges of articles. The rest is decided by the lengths of lines, summed over
sliding windows: a surge is a window whose sum is above a threshold, and text is kept from where it begins to where the sums dive. They dive where a
window is empty, or where a whole window of lines holds hardly any text and no end of a sentence, as in lists of links.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# HTML element names.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "textarea", "select", "button", "canvas", "audio", "video", "math"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *ASIDE}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
# Words in class, id and role that mark what is no part of an article.
_OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?)(?:$|[\s_-])", re.I)
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = ".!?\u2026:;\"'\u00bb\u201d\u3002\uff01\uff1f"
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """A block's text; empty where something was left out."""

    text: str
    heading: bool = False


EMPTY = Line("")


def lines(page: str, window: int = 3) -> list[Line]:
    """The lines of a page. What is left out gives an empty line inside an article and a whole empty window elsewhere, as do an article's edges."""
    out: list[Line] = []
    words: list[str] = []
    open_: list[tuple[str, str | None]] = []  # (name, "hidden", "article" or None)
    hidden = articles = at = 0
    heading = False

    def cut():
        text = _SPACE.sub(" ", html_lib.unescape("".join(words))).strip()
        words.clear()
        if text:
            out.append(Line(text, heading))

    def gap(size: int):
        out.extend([EMPTY] * size)

    while at < len(page):
        m = _MARK.search(page, at)
        if not hidden:
            words.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end
            if name in BLOCK:
                cut()
                heading = heading and name not in HEADINGS
            if any(n == name for n, _ in open_):
                while open_:
                    n, kind = open_.pop()
                    hidden -= kind == "hidden"
                    if kind == "article":
                        articles -= 1
                        gap(window)
                    if n == name:
                        break
            continue
        if name in BLOCK:
            cut()
            heading = name in HEADINGS
        elif name == "br":
            words.append(" ")
        if name in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in VOID or m[0].endswith("/>"):
            continue
        marked = name in BLOCK and name not in ("html", "body") and _marked(m[3])
        if name in ("article", "main") and not marked and not any(k == "hidden" and n not in ("nav", "header", "head", "menu", "form") for n, k in open_):
            # An article is in no menu: what was left open before it ends here.
            hidden, open_ = 0, [x for x in open_ if x[1] != "hidden"]
            gap(1 if articles else window)
            articles += 1
            open_.append((name, "article"))
        elif name in SILENT or name in ASIDE or marked:
            if not hidden:
                gap(1 if articles else window)
            open_.append((name, "hidden"))
            hidden += 1
        elif any(n == name and k == "hidden" for n, k in open_):
            open_.append((name, None))  # only there to find the end of the hidden one
    cut()
    return out


def _marked(attributes: str) -> bool:
    return bool(attributes) and any(_OTHER.search(a or b or c) for a, b, c in _NAMED.findall(attributes))


def low_lines(found: list[Line], window: int = 3, dive: int = 24) -> set[int]:
    """Lines in a window that together have fewer than ``dive`` code points, none of them with the end of a sentence.

    No window reaches over an empty line, or into a heading from before it.
    """
    low: set[int] = set()
    since = 0  # how many lines since the last break
    for i, line in enumerate(found):
        since = 0 if not line.text or line.text[-1] in ENDS else 1 if line.heading else since + 1
        near = range(i - window + 1, i + 1)
        if since >= window and sum(len(found[j].text) for j in near) < dive:
            low.update(near)
    return low


def main_blocks(page: str | None, window: int = 3, surge: int = 86, dive: int = 24) -> list[str]:
    """The text blocks between surges and dives; where nothing surges, those of the region with most text."""
    found = lines(page or "", window)
    sizes = [len(x.text) for x in found]
    sums = [sum(sizes[i : i + window]) for i in range(len(found))]
    low = low_lines(found, window, dive)
    regions: list[list[int]] = [[]]
    for i, total in enumerate(sums):
        if (not total or i in low) and regions[-1]:
            regions.append([])
        if sizes[i] and i not in low:
            regions[-1].append(i)
    kept = [r for r in regions if any(sum(sizes[j] for j in r if i <= j < i + window) > surge for i in r)]
    kept = kept or [max(regions, key=lambda r: sum(sizes[i] for i in r))]
    return [found[i].text for r in kept for i in r]


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (blocks joined by a blank line; empty if none) and n_chars (its code points).

    A null page has an empty text. Whole pages are read; text that repeats stays. All rows and
    columns stay (a former text or n_chars is replaced).
    """

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(["\n\n".join(main_blocks(x)) for x in s], dtype=object)

    out = pages.withColumn("__nav_text", found(F.col(html_col).cast("string"))).drop("text", "n_chars")
    return out.withColumns({"text": F.col("__nav_text"), "n_chars": F.char_length("__nav_text").cast("long")}).drop("__nav_text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
