"""Paragraphs and headings of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "article", "body", "ul", "ol", "li", "table", "blockquote"}


class _Page(HTMLParser):
    """Collects paragraphs and headings; a paragraph ends where the next block begins, as the standard has it."""

    def __init__(self, glue: bool):
        super().__init__(convert_charrefs=True)
        self.glue = glue
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS:
            self.open = None
        if tag in ("p", "h1", "h2", "h3"):
            self.open = []
            self.found.append((tag, self.open))
        elif tag == "br" and self.open is not None:
            self.open.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None and not self.hidden:
            self.open.append(data.strip() if self.glue else data)


def page_parts(html: str | None, glue: bool = False) -> tuple[list[str], dict[str, str]]:
    """(paragraphs, first heading of each level). ``glue`` strips each piece of text and joins them without a separator."""
    page = _Page(glue)
    page.feed(html or "")
    page.close()
    paragraphs, headings = [], {}
    for tag, pieces in page.found:
        text = "".join(pieces)
        text = re.sub(" +", " ", re.sub("\n{3,}", "\n\n", text)).strip()
        if text and tag == "p":
            paragraphs.append(text)
        elif text:
            headings.setdefault(tag, text)
    return paragraphs, headings


def html_paragraphs(pages: DataFrame, key: str, column: str = "html", glue: bool = False) -> DataFrame:
    """(key, paragraphs, h1, h2, h3) of every page; null pages have no paragraphs."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [page_parts(h, glue) for h in batch[column]]
            yield pd.DataFrame({key: batch[key], "paragraphs": [p for p, _ in parts], **{h: [x.get(h) for _, x in parts] for h in ("h1", "h2", "h3")}})

    return pages.select(key, column).mapInPandas(parse, f"{key} {kind}, paragraphs array<string>, h1 string, h2 string, h3 string")
