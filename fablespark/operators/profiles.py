"""Profiles of entities, summaries of chapters, tags of chunks, and checks of input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.operators.extraction import call_model


def require_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The rows as they are; raises if a field is missing from the schema."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df


def token_accounting(chunks: DataFrame, keys: list[str], order: str, tokens: str = "token_count", batch: int = 32) -> DataFrame:
    """(keys, batch, texts, tokens, most, running_avg) of the embedding batches of each key; null tokens count as 0."""
    n = F.coalesce(F.col(tokens), F.lit(0))
    number = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / batch)
    per = chunks.select(*keys, number.alias("batch"), n.alias("n")).groupBy(*keys, "batch").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.max("n").alias("most"))
    so_far = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("running_avg", F.round(F.sum("tokens").over(so_far) / F.sum("texts").over(so_far), 6))


def entity_profiles(entities: DataFrame, pairs: DataFrame, keys: list[str], entity: str, k: int = 5) -> DataFrame:
    """(keys, entity, chapters, aliases, companions): each entity with the k entities it shares most texts with.

    ``pairs`` has (entity_a, entity_b, texts), its entities written like the column ``entity``.
    """
    both = pairs.select(F.col("entity_a").alias(entity), F.col("entity_b").alias("other"), "texts").unionByName(pairs.select(F.col("entity_b").alias(entity), F.col("entity_a").alias("other"), "texts"))
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("texts"), "other"))
    best = both.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "other"))), lambda x: x["other"]).alias("companions"))
    empty = F.array().cast("array<string>")
    own = entities.groupBy(*keys, entity).agg(F.array_sort(F.collect_set("chapter_num")).alias("chapters"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", empty))))).alias("aliases"))
    return own.join(best, entity, "left").withColumn("companions", F.coalesce("companions", empty))


def chapter_summaries(chapters: DataFrame, keys: list[str], factory: Callable, text: str = "text") -> DataFrame:
    """(keys, summary, error): a model's summary of each chapter."""
    asked = call_model(chapters.select(*keys, F.concat(F.lit("Summarise this chapter.\nTEXT:"), F.coalesce(F.col(text), F.lit(""))).alias("prompt")), factory)
    return asked.select(*keys, F.col("response").alias("summary"), "error")


def chunk_tags(hits: DataFrame, chunk_id: str, name: str) -> DataFrame:
    """(chunk_id, tags): the entities that each chunk mentions, in order."""
    return hits.groupBy(chunk_id).agg(F.array_sort(F.collect_set(name)).alias("tags"))


def without_songs(paragraphs: DataFrame, keys: list[str], column: str = "paragraph", least_lines: int = 3, most_chars: int = 60) -> DataFrame:
    """Paragraph rows without verse: paragraphs of several short lines."""
    lines = F.filter(F.split(F.col(column), "\n"), lambda x: tx.strip(x) != "")
    verse = (F.size(lines) >= least_lines) & (F.coalesce(F.array_max(F.transform(lines, lambda x: F.length(x))), F.lit(0)) <= most_chars)
    return paragraphs.where(~verse).select(*keys, "position", column)
