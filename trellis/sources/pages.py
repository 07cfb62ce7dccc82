"""Visible text of web pages: a parser in Arrow batches, and a rougher form in Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.deploy import ship
from trellis.functions.values import ColumnOrName, _col

MOST_CHARS = 32_000
#: Elements that aren't read, roles and marks of such, elements whose own text is read, and the main part of a page.
DROPPED = {"script", "style", "noscript", "iframe", "svg", "img", "nav", "header", "footer"}
DROPPED_ROLES = {"navigation", "banner"}
DROPPED_CLASSES, DROPPED_IDS = ("cookie", "popup", "modal"), ("cookie",)
READ = {"h1", "h2", "h3", "h4", "p", "li", "td", "th", "span", "div", "a"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Lines of an element's own text, in order of the elements; those in the page's main part apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int | None]] = []  # tag, dropped, line
        self.lines: list[tuple[list[str], bool]] = []
        self.main_at: int | None = None
        self.has_main = False

    def _is_main(self, tag: str, a: dict) -> bool:
        return tag in ("main", "article") or a.get("role") == "main" or a.get("id") in ("content", "main") or "content" in (a.get("class") or "").split()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes, id_ = a.get("class") or "", a.get("id") or ""
        out = bool(self.open and self.open[-1][1]) or tag in DROPPED or a.get("role") in DROPPED_ROLES
        out = out or any(c in classes for c in DROPPED_CLASSES) or any(c in id_ for c in DROPPED_IDS)
        if tag in VOID:
            return
        if not out and not self.has_main and self._is_main(tag, a):
            self.has_main, self.main_at = True, len(self.open)
        line = None
        if not out and tag in READ:
            line = len(self.lines)
            inside = self.main_at is not None and len(self.open) > self.main_at
            self.lines.append(([], inside))
        self.open.append((tag, out, line))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                if self.main_at is not None and len(self.open) <= self.main_at:
                    self.main_at = None
                return

    def handle_data(self, data):
        if self.open and not self.open[-1][1] and self.open[-1][2] is not None:
            self.lines[self.open[-1][2]][0].append(data)

    def text(self, most: int) -> str:
        own = [("".join(parts).strip(), inside) for parts, inside in self.lines]
        kept = [t for t, inside in own if len(t) > 1 and (inside or not self.has_main)]
        joined = "\n".join(kept)
        return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", joined)).strip()[:most]


#: An ampersand, and what it begins if that is closed.
_AMPERSAND = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9A-Fa-f]+;)|([A-Za-z][A-Za-z0-9]*;))?")


def _only_closed(html: str) -> str:
    """``html`` with its ampersands that begin no closed entity written as such, so that they are read as they stand."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], html)


def page_text(html: str | None, most: int = MOST_CHARS, closed: bool = False) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(_only_closed(html) if closed else html)
    parser.close()
    return parser.text(most)


def visible_text(pages: DataFrame, html: str = "html", name: str = "text", most: int = MOST_CHARS, closed: bool = False) -> DataFrame:
    """``pages`` with the visible text of each, cut at ``most`` characters as what reads it expects.

    Browsers read ``&amp`` without its semicolon as an ampersand, too; with ``closed`` only entities that end in one are read.

    The page's main part if it has one, else its body, without navigation, scripts and notices; one
    line for each element that has text of its own."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda h: page_text(h, most, closed), na_action="ignore")

    return pages.withColumn(name, run(F.col(html)))


def rough_text(html: ColumnOrName, most: int = MOST_CHARS) -> Column:
    """An approximation of visible_text() without a parser: dropped elements go with what they hold, other tags become
    line breaks, the common entities their characters. It doesn't look for the main part."""
    out = _col(html)
    for tag in ("script", "style", "noscript", "iframe", "svg", "nav", "header", "footer", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->|<![^>]*>", ""), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.substring(F.regexp_replace(out, r"^\s+|\s+$", ""), 1, most)
