"""Resumable ingest with Structured Streaming: each chapter file is processed once, whatever happens in between."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Processes the JSON files that are new in ``source`` and appends the result to parquet files in ``target``.

    The checkpoint keeps which files are done; a batch that is run again overwrites its own folder, so its rows come once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).json(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(chapters: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The chapters that are not among those done."""
    return chapters.join(done.select(*keys).distinct(), keys, "left_anti")


def remember_entities(entities: DataFrame) -> DataFrame:
    """Per book and type, the names known so far, each time a chapter adds to them; state is kept per (book, type).

    ``entities`` is a stream of (book_num, chapter_num, entity_type, name).
    """

    def update(key: tuple, batches, state: GroupState):
        known = set(state.get[0]) if state.exists else set()
        before, chapter = len(known), 0
        for b in batches:
            known |= {n for n in b["name"] if n}
            chapter = max(chapter, int(b["chapter_num"].max()))
        state.update((sorted(known),))
        yield pd.DataFrame({"book_num": [key[0]], "entity_type": [key[1]], "chapter_num": [chapter], "known": [len(known)], "added": [len(known) - before]})

    return entities.groupBy("book_num", "entity_type").applyInPandasWithState(update, "book_num int, entity_type string, chapter_num int, known int, added int", "names array<string>", "append", GroupStateTimeout.NoTimeout)


def active_entity(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", entity: str = "entity") -> DataFrame:
    """The turns with ``active``: the entity named last, up to and including the turn, for pronouns to refer to."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("active", F.last(entity, ignorenulls=True).over(w))


def event_windows(events: DataFrame, time: str = "ts", delay: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Number and sum of events per type and window of event time; events later than the delay are left out of a stream."""
    late = events.withWatermark(time, delay) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return late.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
