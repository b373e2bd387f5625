"""E-books: the pages of an EPUB container in reading order."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def book_pages(content: bytes) -> list[tuple[str, str]]:
    """(name, HTML) of the pages that the package lists, in its order; of all pages by name if it lists none."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        package = next((n for n in names if n.endswith(".opf")), None)
        wanted = _spine(book.read(package), posixpath.dirname(package)) if package else []
        wanted = [n for n in wanted if n in names] or sorted(n for n in names if re.search(r"\.x?html?$", n, re.I))
        return [(n, book.read(n).decode("utf-8", "ignore")) for n in wanted]


def _spine(xml: bytes, folder: str) -> list[str]:
    root = ElementTree.fromstring(xml)
    bare = lambda e: e.tag.rpartition("}")[2]
    items = {e.get("id"): (e.get("href", ""), e.get("media-type", "")) for e in root.iter() if bare(e) == "item"}
    order = [e.get("idref") for e in root.iter() if bare(e) == "itemref"] or list(items)
    return [posixpath.normpath(posixpath.join(folder, unquote(items[i][0]))) for i in order if i in items and "html" in items[i][1]]


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, name, html) of every page of the books under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                pages = book_pages(bytes(content))
                yield pd.DataFrame({"path": where, "position": range(len(pages)), "name": [n for n, _ in pages], "html": [h for _, h in pages]})

    return files.select("path", "content").mapInPandas(unpack, "path string, position int, name string, html string")
