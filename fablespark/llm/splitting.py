"""Splitting oversized texts at natural boundaries with a sparse table over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.llm.sentences import sentence_spans

#: Characters that are a token each, and the blanks between tokens.
SINGLE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff"
BLANK = " \t\n\u00a0\u3000"
TOKEN = f"[{SINGLE}]|[^{BLANK}{SINGLE}]+"

#: Strengths of a cut before a token, from the strongest.
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, NONE = 5, 4, 3, 2, 1, 0

_TOKEN = re.compile(TOKEN)
_PARAGRAPH = re.compile(r"\n[ \t\r\u00a0\u3000]*\n")
#: Marks that end a clause, and marks that may follow them.
CLAUSE_ENDS, CLOSING = ",;:،؛、，；：—–·", "\"'’”»」』）)]"

PIECES = "chunk_id string, piece_index int, n_pieces int, start_pos int, end_pos int, tokens int, text string"


def _kinds() -> np.ndarray:
    kinds = np.ones(65536, dtype=np.uint8)  # 0 a blank, 1 part of a run, 2 a token by itself
    kinds[[ord(c) for c in BLANK]] = 0
    for first, last in ((0x0E00, 0x0E7F), (0x3040, 0x30FF), (0x3400, 0x9FFF)):
        kinds[first : last + 1] = 2
    return kinds


_KIND = _kinds()


def token_counts(texts: list[str]) -> np.ndarray:
    """Number of tokens of each text, all texts in one pass."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _KIND[np.minimum(codes, 65535)]
    begins = kind == 2
    begins[1:] |= (kind[1:] == 1) & (kind[:-1] != 1)
    if len(kind):
        begins[0] |= kind[0] == 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])


def boundary_strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """Strength of a cut before token i (index 0 is unused); sentences are those of the sentence splitter."""
    strengths = np.zeros(len(spans), dtype=np.int8)
    if len(spans) < 2:
        return strengths
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    left, right = spans[:-1, 1], spans[1:, 0]
    out = np.where(right > left, WORD, NONE)
    at, closing = left - 1, np.isin(codes, [ord(c) for c in CLOSING])
    while (back := closing[at] & (at > spans[:-1, 0])).any():
        at = at - back
    out[np.isin(codes[at], [ord(c) for c in CLAUSE_ENDS])] = CLAUSE
    lines = np.flatnonzero(codes == 10)
    out[np.searchsorted(lines, right) > np.searchsorted(lines, left)] = LINE
    starts, _ = sentence_spans(text)
    last = np.searchsorted(starts, right, side="right") - 1
    out[(last >= 0) & (starts[np.maximum(last, 0)] >= left)] = SENTENCE
    for m in _PARAGRAPH.finditer(text):
        gap = int(np.searchsorted(left, m.start(), side="right")) - 1
        if gap >= 0 and m.start() < right[gap]:
            out[gap] = PARAGRAPH
    strengths[1:] = out
    return strengths


class RangeMaximum:
    """Sparse table for the rightmost position of the largest value in a range."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            a, b = last[: len(last) - width], last[width:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            width *= 2

    def rightmost(self, first: int, last: int) -> int:
        """Position of the maximum in first..last, both included; the rightmost of equals."""
        level = (last - first + 1).bit_length() - 1
        a, b = int(self.levels[level][first]), int(self.levels[level][last - (1 << level) + 1])
        if self.values[a] == self.values[b]:
            return max(a, b)
        return a if self.values[a] > self.values[b] else b


def split_tokens(strengths: np.ndarray, limit: int, overlap: int, least_fill: float = 0.5) -> list[tuple[int, int]]:
    """Token ranges of the pieces: each at most ``limit`` long, neighbours sharing ``overlap`` tokens.

    A piece ends at the strongest boundary between ``least_fill`` of the limit and the limit. An overlap of the limit
    or more is lowered to the limit less one token.
    """
    n = len(strengths)
    limit = max(1, int(limit))
    overlap = min(max(0, int(overlap)), limit - 1)
    if n <= limit:
        return [(0, n)]
    table = RangeMaximum(strengths)
    least = max(overlap + 1, int(np.ceil(limit * least_fill)))
    pieces, start = [], 0
    while n - start > limit:
        end = table.rightmost(start + least, start + limit)
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text; a text within the limit is one piece."""
    spans = np.array([m.span() for m in _TOKEN.finditer(text)], dtype=np.int64).reshape(-1, 2)
    if not len(spans):
        return [(0, 0, 0)]
    return [(int(spans[a, 0]), int(spans[b - 1, 1]), b - a) for a, b in split_tokens(boundary_strengths(text, spans), limit, overlap)]


def _oversized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin in range(0, len(batch), 1000):
            part = batch.iloc[begin : begin + 1000]
            yield part[token_counts(part["text"].tolist()) > part["max_tokens"].clip(lower=1).to_numpy()]


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for chunk_id, text, limit, overlap in batch.itertuples(index=False):
            pieces = split_text(text, limit, 0 if pd.isna(overlap) else overlap)
            rows += [(chunk_id, k, len(pieces), a, b, n, text[a:b]) for k, (a, b, n) in enumerate(pieces, 1)]
        yield pd.DataFrame(rows, columns=["chunk_id", "piece_index", "n_pieces", "start_pos", "end_pos", "tokens", "text"])


def split_oversized(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pieces of every distinct chunk whose text has more tokens than its profile allows.

    Tokens are counted on the stored text, whatever token_count says, and only oversized texts are shuffled and go on to
    the splitter. Chunks with null text, null chunk_id, no known profile or a null limit have no size to exceed and give
    no rows; re-delivered chunks count once; limits below 1 count as 1. Columns beside the needed ones are ignored.
    """
    limits = profiles.where("max_tokens IS NOT NULL").groupBy("profile_id").agg(F.min("max_tokens").alias("max_tokens"), F.min("overlap_tokens").alias("overlap_tokens"))
    oversized = (
        chunks.select("chunk_id", "text", "profile_id")
        .where("chunk_id IS NOT NULL AND text IS NOT NULL AND profile_id IS NOT NULL")
        .join(limits, "profile_id")  # a table of profiles is small: the planner broadcasts it if its size allows
        .where(F.length("text") > F.greatest("max_tokens", F.lit(1)))  # no text has more tokens than characters
        .select("chunk_id", "text", "max_tokens", "overlap_tokens")
        .mapInPandas(_oversized, "chunk_id string, text string, max_tokens int, overlap_tokens int")
        .groupBy("chunk_id")
        .agg(F.min(F.struct("text", "max_tokens", "overlap_tokens")).alias("x"))
        .select("chunk_id", "x.text", "x.max_tokens", "x.overlap_tokens")
    )
    return oversized.mapInPandas(_split_batches, PIECES)
