"""Token counts of documents by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """The byte-level BPE encoder of a rank file, made once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of a text; null and empty texts have none."""
    return len(encoder(path).encode_ordinary(text)) if text else 0


def document_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document.

    Source spellings are folded to lower case with underscores; a null or blank source becomes ``unknown``. A doc_id that
    is stored more than once counts once: its latest row by ingested_at, of these the one with most tokens; rows without doc_id are left out.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "source", "at"]].assign(tokens=[count_tokens(t, path) for t in batch["text"]])

    folded = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("source")), "[- ]+", "_"), F.lit("")), F.lit("unknown"))
    at = F.unix_micros("ingested_at") if "ingested_at" in documents.columns else F.lit(None).cast("long")
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", folded.alias("source"), at.alias("at"), "text")
    counted = rows.mapInPandas(count, "doc_id long, source string, at long, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("at", "tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens")
