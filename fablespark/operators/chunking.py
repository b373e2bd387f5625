"""Chunking of texts: packing by size, splitting, windows, the semantic chunker, merging of tiny chunks, statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.params import ChunkProfile

# --- Packing and splitting as folds over arrays ---------------------------------------------------------------------------------


def pack_groups(sizes: Column, limit: int, separator: int = 0) -> Column:
    """Group number, from 1, of each unit of an array of sizes: a unit begins a group when it would exceed the limit.

    A unit above the limit is a group of its own. ``separator`` is the cost of joining two units.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["group"] > 0) & (s["used"] + separator + n <= limit)
        group = F.when(fits, s["group"]).otherwise(s["group"] + 1)
        return F.struct(F.when(fits, s["used"] + separator + n).otherwise(n.cast("long")).alias("used"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def packed(units: Column, sizes: Column, limit: int, separator: int = 0, glue: str = " ") -> Column:
    """The units of an array joined into pieces within a size limit."""
    groups = pack_groups(sizes, limit, separator)
    tagged = F.arrays_zip(units.alias("u"), groups.alias("g"))
    numbers = F.array_distinct(groups)
    return F.transform(numbers, lambda k: F.array_join(F.transform(F.filter(tagged, lambda x: x["g"] == k), lambda x: x["u"]), glue))


def pack_paragraphs(text: Column, limit: int) -> Column:
    """Paragraphs packed into pieces of at most ``limit`` characters, a blank line apart; one above the limit is split by sentences."""
    parts = F.flatten(F.transform(tx.blank_line_parts(text, loose=True), lambda p: F.when(F.length(p) > limit, split_long(p, limit)).otherwise(F.array(p))))
    return packed(parts, F.transform(parts, lambda p: F.length(p)), limit, 2, "\n\n")


def split_long(text: Column, limit: int) -> Column:
    """Sentences packed into pieces of at most ``limit`` characters; a sentence above the limit is cut into slices."""
    parts = F.flatten(F.transform(tx.sentences(text), lambda s: F.when(F.length(s) > limit, tx.char_slices(s, limit)).otherwise(F.array(s))))
    return packed(parts, F.transform(parts, lambda p: F.length(p)), limit, 1, " ")


def split_or_keep(text: Column, limit: int) -> Column:
    """A text within the limit as it is, stripped; a longer one packed by paragraphs; an empty one gives nothing."""
    whole = tx.strip(text)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(pack_paragraphs(text, limit))


def overlapping_windows(text: str, target: int, longest: int, overlap: int, look_ahead: int = 200) -> list[str]:
    """Windows of about ``target`` characters that end after a sentence, or at a space, and share ``overlap`` characters."""
    out, start = [], 0
    while start < len(text):
        end = min(start + target, len(text))
        if end < len(text):
            ahead = text[start : min(end + look_ahead, start + longest, len(text))]
            stop = max(ahead.rfind(m) for m in (". ", "! ", "? "))
            space = text.rfind(" ", start, min(start + longest, len(text)))
            end = start + stop + 1 if stop >= overlap + 1 else space if space > start + overlap else min(start + longest, len(text))
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def window_rows(df: DataFrame, key: str, column: str, target: int, longest: int, overlap: int) -> DataFrame:
    """(key, window, text) of the overlapping windows of every text."""
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, w) for k, t in zip(batch[key], batch[column]) if t for n, w in enumerate(overlapping_windows(t, target, longest, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "window", "text"])

    return df.select(key, column).mapInPandas(cut, f"{key} {kind}, window int, text string")


# --- The semantic chunker -------------------------------------------------------------------------------------------------------


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of word counts under a fixed hash: the embedding used where no model is given."""
    out = np.zeros((len(texts), size))
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = 2166136261
            for c in w.encode():
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            out[k, h % size] += 1 - 2 * (h >> 16 & 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def count_words(text: str) -> int:
    return len(text.split())


def chunk_units(text: str, p: ChunkProfile, count: Callable[[str], int]) -> list[str]:
    """Sentences, or paragraphs and the sentences of those too long; a sentence above the maximum is packed word by word."""
    paragraphs = [x.strip() for x in text.split("\n\n") if x.strip()]
    if p.base_unit == "paragraph":
        first = [[x] if count(x) <= p.max_tokens else _sentences(x) for x in paragraphs]
    elif p.base_unit == "sentence":
        first = [_sentences(x) for x in paragraphs]
    else:
        return []
    return [piece for units in first for u in units for piece in ([u] if count(u) <= p.max_tokens else _by_words(u, p.max_tokens, count))]


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def _by_words(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    out: list[list[str]] = []
    used = limit + 1
    for w in text.split():
        n = count(w)
        if used + n > limit:
            out.append([])
            used = 0
        out[-1].append(w)
        used += n
    return [" ".join(x) for x in out]


def semantic_chunks(text: str, p: ChunkProfile, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of a text: units are added up to the maximum, and a chunk above the minimum ends before a dissimilar unit.

    If the embedding fails, chunks are packed by size alone. With an overlap, the next chunk begins some units earlier.
    """
    units = chunk_units(text or "", p, count)
    if not units:
        return []
    try:
        vectors = np.asarray(embed(units), dtype=float)
    except Exception:  # noqa: BLE001 - any failure of a model
        vectors = None
    out, at = [], 0
    while at < len(units):
        end, joined = at, ""
        while end < len(units):
            longer = f"{joined} {units[end]}" if joined else units[end]
            if end > at and count(longer) > p.max_tokens:
                break
            joined, end = longer, end + 1
            if vectors is not None and end < len(units) and end - at >= 2 and count(joined) >= p.min_tokens and _cosine(vectors[end - 1], vectors[end]) < p.similarity_threshold:
                break
        out.append(joined)
        back, tokens = 0, 0
        while p.overlap_tokens and back < end - at - 1 and tokens < p.overlap_tokens:
            more = tokens + count(units[end - 1 - back])
            if more > 1.5 * p.overlap_tokens:
                break
            tokens, back = more, back + 1
        at = max(end - back if end < len(units) else end, at + 1)
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def chunk_chapters(chapters: DataFrame, p: ChunkProfile = ChunkProfile(), embed: Callable[[list[str]], np.ndarray] = hashed_embedding, count: Callable[[str], int] = count_words) -> DataFrame:
    """(book_num, chapter_num, raw_index, text, tokens) of every chapter (book_num, chapter_num, paragraphs)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, c, k, t, count(t)) for b, c, text in zip(batch["book_num"], batch["chapter_num"], batch["text"]) for k, t in enumerate(semantic_chunks(text, p, embed, count), 1)]
            yield pd.DataFrame(rows, columns=["book_num", "chapter_num", "raw_index", "text", "tokens"])

    whole = chapters.select("book_num", "chapter_num", F.array_join("paragraphs", "\n\n").alias("text"))
    return whole.mapInPandas(cut, "book_num int, chapter_num int, raw_index int, text string, tokens int")


# --- Chunk tables ---------------------------------------------------------------------------------------------------------------


def merge_tiny(chunks: DataFrame, keys: list[str], order: str, tokens: str, text: str, least: int) -> DataFrame:
    """Chunks below the least size joined to the one before them; a first chunk stays even if it is tiny.

    Each chunk counts with its own tokens, so the groups are a running count of the chunks that stand for themselves. Returns
    (keys, group, chunks, tokens, text); null tokens count as 0 and null texts as empty.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    own = F.coalesce(F.col(tokens), F.lit(0))
    heads = chunks.withColumn("_group", F.sum(F.when((own >= least) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return heads.groupBy(*keys, F.col("_group").alias("group")).agg(F.count("*").alias("chunks"), F.sum(own).alias("tokens"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def chunk_records(chunks: DataFrame, source: str, book_title: str) -> DataFrame:
    """Chunk records with position, number of chunks and identifier of (book_num, chapter_num, chapter_title, group, text, tokens)."""
    w = Window.partitionBy("book_num", "chapter_num")
    index = F.row_number().over(w.orderBy("group"))
    rows = chunks.withColumn("chunk_index", index).withColumn("total_chunks_in_chapter", F.count("*").over(w).cast("int"))
    return rows.select(
        F.lit(source).alias("source"),
        F.col("book_num").alias("book_number"),
        F.lit(book_title).alias("book_title"),
        F.col("chapter_num").alias("chapter_number"),
        "chapter_title",
        F.lit("chapter").alias("chapter_type"),
        "text",
        F.col("tokens").cast("int").alias("token_count"),
        F.col("chapter_num").alias("temporal_order"),
        "chunk_index",
        "total_chunks_in_chapter",
        tx.chunk_id(F.col("book_num"), F.col("chapter_num"), F.col("chunk_index")).alias("chunk_id"),
    )


def chunk_stats(chunks: DataFrame, book: str = "book_number", chapter: str = "chapter_number", text: str = "text", tokens: str = "token_count") -> DataFrame:
    """Number, sums, averages (rounded down), least and greatest of characters and tokens per chapter, per book and in total."""
    n, t = F.length(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(tokens), F.lit(0))
    level = F.grouping_id().alias("level")
    return chunks.rollup(book, chapter).agg(
        level,
        F.count("*").alias("chunks"),
        *[f.alias(f"{name}_{what}") for what, c in (("chars", n), ("tokens", t)) for name, f in (("total", F.sum(c)), ("avg", F.floor(F.avg(c))), ("min", F.min(c)), ("max", F.max(c)))],
    )


def link_neighbours(chunks: DataFrame, keys: list[str], order: list[str], chunk_id: str = "chunk_id") -> DataFrame:
    """(keys, chunk_id, prev_chunk_id, next_chunk_id)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.select(*keys, chunk_id, F.lag(chunk_id).over(w).alias("prev_chunk_id"), F.lead(chunk_id).over(w).alias("next_chunk_id"))
