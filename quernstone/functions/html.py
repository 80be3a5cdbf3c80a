"""Visible text of HTML, with the standard parser inside an Arrow UDF.

A page becomes a list of blocks, each with the region it stands in (the innermost that says something: hidden, main or page); which
regions count is decided afterwards, from the lengths of their texts.
"""
from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is not shown, elements that break lines, elements that hold a page's main text, elements without an end.
HIDDEN = frozenset("script style noscript nav footer header svg form template".split())
BLOCK = frozenset("p div section article main li ul ol h1 h2 h3 h4 h5 h6 br tr table blockquote pre dd dt".split())
MAIN = frozenset(("main", "article"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Least part of the page's text, and least length, of a main text that stands for the page.
SHARE, LENGTH = 0.25, 400


class Blocks(HTMLParser):
    """(region, text) of each line of a page, white space squeezed."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = [("", "page")]
        self.lines: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.open).split())
        if text:
            self.lines.append((self.path[-1][1], text))
        self.open = []

    def handle_starttag(self, tag, attrs):
        held = self.path[-1][1]
        region = held if held == "hidden" else "hidden" if tag in HIDDEN else "title" if tag == "title" else "main" if tag in MAIN or ("role", "main") in attrs else held
        if tag in BLOCK or region != held:
            self.flush()
        if tag not in VOID:
            self.path.append((tag, region))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.path) - 1, 0, -1) if self.path[i][0] == tag), None)
        if tag in BLOCK or at is not None and self.path[at - 1][1] != self.path[-1][1]:
            self.flush()
        if at is not None:
            del self.path[at:]

    def handle_data(self, data):
        self.open.append(data)


def regions(html: str | None) -> dict[str, str]:
    """Text of each region, a block a line; ``all`` is what is shown."""
    lines = Blocks(html or "").lines
    text = lambda *names: "\n".join(t for r, t in lines if r in names)
    return {"all": text("page", "main"), "main": text("main"), "title": text("title").replace("\n", " ")}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))
def html_text(html: pd.Series) -> pd.DataFrame:
    """All visible text, a block a line, and the title."""
    return pd.DataFrame([(r["all"], r["title"]) for r in map(regions, html)], columns=["text", "title"])


@F.pandas_udf(T.StringType())
def html_main_text(html: pd.Series) -> pd.Series:
    """The main text where it is more than a quarter of the page and 400 characters, else all visible text."""
    chosen = [r["main"] if len(r["main"]) > max(SHARE * len(r["all"]), LENGTH) else r["all"] for r in map(regions, html)]
    return pd.Series(chosen, dtype="object")
