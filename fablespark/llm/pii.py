"""Personal information inside free text: located by the trained tagger and replaced by placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.pii_model import KINDS, trained
from fablespark.runtime import cleaned

#: Characters of a batch that are tagged together.
_BATCH_CHARS = 4_000_000
#: Characters that no span begins or ends with; closing brackets and full stops are left where they may belong to it.
_EDGES = " \t\n\r 　<>,;:"


def text_spans(texts: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """(text number, start, end, kind) of each stretch of personal information."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < _BATCH_CHARS):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        for k, spans in enumerate(trained().spans(part)):
            for a, b, kind in spans:
                for x, y in single_pieces(part[k], a, b, KINDS[kind]):
                    x, y = exact_edges(part[k], x, y)
                    if y > x:
                        yield begin + k, x, y, KINDS[kind]
        begin = end


def single_pieces(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """The span, or its parts if it holds several e-mail addresses one after the other."""
    marks = [m.start() for m in re.finditer("[@＠]", text[a:b])] if kind == "email" else []
    if len(marks) < 2:
        return [(a, b)]
    cuts = []
    for x, y in zip(marks, marks[1:]):
        gap = re.search(r"\s+(?=[^\s@＠]+\s?$)", text[a + x : a + y])
        if gap:
            cuts.append(a + x + gap.end())
    edges = [a, *cuts, b]
    return list(zip(edges, edges[1:]))


def exact_edges(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without blanks and marks at its edges, widened to whole words; nothing else that the tagger found is left out."""
    while a < b and text[a] in _EDGES:
        a += 1
    while a < b and text[b - 1] in _EDGES:
        b -= 1
    while 0 < a < b and text[a - 1].isascii() and text[a - 1].isalnum() and text[a].isascii() and text[a].isalnum():
        a -= 1
    while a < b < len(text) and text[b].isascii() and text[b].isalnum() and text[b - 1].isascii() and text[b - 1].isalnum():
        b += 1
    return a, b


_TEXT = "_text_hash"


def _span_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, hashes, texts = batch["doc_id"].to_numpy(), batch[_TEXT].to_numpy(), batch["text"].tolist()
        rows = [(ids[k], hashes[k], a, b, kind, texts[k][a:b]) for k, a, b, kind in text_spans(texts)]
        yield pd.DataFrame(rows, columns=["doc_id", _TEXT, "start_pos", "end_pos", "kind", "piece"])


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias(_TEXT), "text")


def _spans_by_text(documents: DataFrame, known_names: DataFrame | None) -> DataFrame:
    """Spans with the hash of their text, so that different texts of one doc_id keep their own."""
    texts = _hashed(documents.where("doc_id IS NOT NULL AND length(text) > 0"))
    spans = texts.mapInPandas(_span_batches, f"doc_id long, {_TEXT} long, start_pos int, end_pos int, kind string, piece string")
    if known_names is not None:
        # Only found names are looked up: each is a key of the join, and the known names need not fit anywhere.
        known = known_names.select(cleaned(F.col("name")).alias("known"), F.lit("person").alias("known_kind")).where("known IS NOT NULL").distinct()
        spans = spans.join(known, (cleaned(F.col("piece")) == F.col("known")) & (F.col("kind") == F.col("known_kind")), "left_anti")
    return spans.drop("piece").distinct()


def find_personal_data(documents: DataFrame, known_names: DataFrame | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind) of each stretch of personal information, in characters.

    Every text is tagged whole. ``known_names`` (column name) holds names of the stories, which are no personal data: a person whose
    cleaned name is among them gives no row. Null and empty texts have none, rows without doc_id are left out, and a stored row
    that is repeated gives its stretches once.
    """
    return _spans_by_text(documents, known_names).select("doc_id", "start_pos", "end_pos", "kind").distinct()


def redact(documents: DataFrame, known_names: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): each text with its stretches replaced by placeholders such as ``<EMAIL>``, the rest unchanged.

    Texts without stretches, and rows without doc_id, come as they are; of several rows with one doc_id each has its own text's
    stretches replaced.
    """
    marks = _spans_by_text(documents, known_names).groupBy("doc_id", _TEXT).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("marks"))
    joined = _hashed(documents).join(marks, ["doc_id", _TEXT], "left")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("done"))
    step = lambda s, m: F.struct(
        F.concat(s["out"], F.array(F.substring(F.col("text"), s["done"] + 1, m["start_pos"] - s["done"]), F.concat(F.lit("<"), F.upper(m["kind"]), F.lit(">")))).alias("out"),
        m["end_pos"].alias("done"),
    )
    built = F.aggregate("marks", zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["done"] + 1, F.length("text"))))
    return joined.select("doc_id", F.when(F.col("marks").isNull() | F.col("text").isNull(), F.col("text")).otherwise(built).alias("text"))
