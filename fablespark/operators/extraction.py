"""Entity extraction with a text model: prompts, calls with retries, structuring, statistics of characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.functions.jsonfix import parse_lenient
from fablespark.operators.entities import merge_aliases, merge_raw, named
from fablespark.operators.mentions import entities_in_texts
from fablespark.params import ExtractionParams
from fablespark.schemas import LEGACY_TYPES, RAW_ENTITY, STATS_RESPONSE

ENTITIES = f"entities ARRAY<STRUCT<{RAW_ENTITY.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>"
#: The groups of types that are structured by one call each.
STRUCTURE_GROUPS = [["location"], ["object"], ["event"], ["concept"], ["character", "group"]]


def call_model(prompts: DataFrame, factory: Callable[[], Callable[[str], str]], max_retries: int = 2) -> DataFrame:
    """The rows with ``response`` and ``error`` for their column ``prompt``.

    The model is made once per task. A call that fails is tried again; after the last attempt the response is null and the
    error kept, so a failing prompt fails no job. A null prompt is not asked.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            responses, errors = [], []
            for prompt in batch["prompt"]:
                response, error = None, None
                for _ in range(max_retries + 1 if prompt is not None else 0):
                    try:
                        response, error = model(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the service raises
                        error = f"{type(e).__name__}: {e}"
                responses.append(response)
                errors.append(error)
            yield batch.assign(response=responses, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(ask, f"{schema}, response string, error string")


def extraction_prompt(text: Column, context: Column) -> Column:
    return F.concat(F.lit("Known entities:\n"), F.coalesce(context, F.lit("")), F.lit("\nReturn the entities as JSON.\nTEXT:"), text)


def extract_raw(chunks: DataFrame, factory: Callable, keys: list[str], context: DataFrame | None = None, p: ExtractionParams = ExtractionParams()) -> DataFrame:
    """(keys, position, entity_type, name, description, aliases): the entities of each text, one prompt per chunk or slice."""
    rows = chunks.select(*keys, "text")
    if not p.use_semantic_chunks:
        rows = rows.select(*keys, F.explode(tx.char_slices(F.col("text"), p.slice_chars)).alias("text"))
    rows = rows.join(context, [c for c in keys if c in context.columns], "left") if context is not None else rows.withColumn("context", F.lit(None).cast("string"))
    asked = call_model(rows.select(*keys, extraction_prompt(F.col("text"), F.col("context")).alias("prompt")), factory, p.max_retries)
    answered = asked.select(*keys, parse_lenient(F.col("response"), ENTITIES).alias("r")).where("r IS NOT NULL")
    return named(answered.select(*keys, F.posexplode("r.entities").alias("position", "e")).select(*keys, "position", "e.*"))


def structure_entities(raw: DataFrame, factory: Callable, keys: list[str], p: ExtractionParams = ExtractionParams()) -> DataFrame:
    """(keys, types, entity_type, name, description, aliases, error): raw entities merged by type and name, and structured by one call per chapter and group of types.

    Groups without entities cost no call. Where the answer can't be read, the merged entities come as they are, descriptions joined, with
    the error or ``unreadable``.
    """
    merged = merge_raw(raw.withColumn("_o", F.struct(*keys, "position").cast("string")), [*keys, "entity_type", "name"], "_o") if p.merge_before_structure else raw.withColumn("description", F.array("description"))
    group = F.coalesce(*[F.when(F.col("entity_type").isin(g), F.lit("+".join(g))) for g in STRUCTURE_GROUPS])
    per = merged.withColumn("types", group).where("types IS NOT NULL").groupBy(*keys, "types").agg(F.to_json(F.array_sort(F.collect_list(F.struct("entity_type", "name", "description", "aliases")))).alias("items"))
    asked = call_model(per.select(*keys, "types", "items", F.concat(F.lit("Structure these entities as JSON.\n"), F.col("items")).alias("prompt")), factory, p.max_retries)
    answer = parse_lenient(F.col("response"), ENTITIES)["entities"]
    sent = F.from_json("items", "array<struct<entity_type: string, name: string, description: array<string>, aliases: array<string>>>")
    plain = F.transform(sent, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["name"].alias("name"), F.array_join(e["description"], " ").alias("description"), e["aliases"].alias("aliases")))
    read = F.transform(answer, lambda e: F.struct(e["entity_type"].alias("entity_type"), e["name"].alias("name"), e["description"].alias("description"), e["aliases"].alias("aliases")))
    rows = asked.select(*keys, "types", F.when(answer.isNotNull(), F.col("error")).otherwise(F.coalesce("error", F.lit("unreadable"))).alias("error"), F.explode(F.coalesce(read, plain)).alias("e"))
    return named(rows.select(*keys, "types", "e.*", "error"))


def legacy_prompts(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """One prompt per chapter and each of the eight older types."""
    types = F.explode(F.array(*[F.lit(t) for t in LEGACY_TYPES]))
    return chapters.select(*keys, "text", types.alias("entity_type")).select(*keys, "entity_type", F.concat(F.lit("Return all entities of type "), F.col("entity_type"), F.lit(" as JSON.\nTEXT:"), F.col("text")).alias("prompt"))


def character_statistics(chunks: DataFrame, characters: DataFrame, factory: Callable, on: list[str], chunk_keys: list[str], p: ExtractionParams = ExtractionParams()) -> DataFrame:
    """Mentions, dialogues and actions of each character, in all and per chapter, asked per (character, chunk that names it).

    ``on`` holds the book and ``chunk_keys`` the book, chapter and chunk. Chapters without a matching chunk have no entry, and
    chapters_appeared counts those with mentions.
    """
    hits = entities_in_texts(chunks, chunk_keys, characters, [*on, "name"], on)
    prompts = hits.join(chunks.select(*chunk_keys, "text"), chunk_keys).select(*chunk_keys, "name", F.concat(F.lit("CHARACTER: "), F.col("name"), F.lit("\nTEXT:"), F.col("text")).alias("prompt"))
    asked = call_model(prompts, factory, p.max_retries)
    s = asked.select(*chunk_keys, "name", parse_lenient(F.col("response"), STATS_RESPONSE).alias("s")).where("s IS NOT NULL")
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    chapter = [c for c in chunk_keys if c not in on][0]
    per = s.groupBy(*on, "name", chapter).agg(n("s.mentions_by_others").alias("mentions"), n("s.dialogues").alias("dialogues"), n("s.actions").alias("actions"), F.flatten(F.collect_set(F.coalesce("s.new_aliases", F.array().cast("array<string>")))).alias("found"))
    return per.groupBy(*on, "name").agg(
        F.sum("mentions").alias("total_mentions"),
        F.sum("dialogues").alias("total_dialogues"),
        F.sum("actions").alias("total_actions"),
        F.count_if(F.col("mentions") > 0).alias("chapters_appeared"),
        F.array_sort(F.collect_list(F.struct(F.col(chapter).alias("chapter_num"), "mentions", "dialogues", "actions"))).alias("per_chapter"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("new_aliases"),
    )


def with_new_aliases(characters: DataFrame, statistics: DataFrame, on: list[str]) -> DataFrame:
    """The characters with the aliases that ``character_statistics`` has found merged into theirs; others stay as they are."""
    found = statistics.select(*on, "name", F.col("new_aliases").alias("_new"))
    merged = F.when(F.col("_new").isNotNull(), merge_aliases(F.col("aliases"), F.col("_new"))).otherwise(F.col("aliases"))
    return characters.join(found, [*on, "name"], "left").withColumn("aliases", merged).select(*characters.columns)


def clean_up(entities: DataFrame, factory: Callable, p: ExtractionParams = ExtractionParams()) -> DataFrame:
    """One prompt per type over its entities; where the answer can't be read, the type stays as it is."""
    per = entities.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("name", "aliases"))).alias("items"))
    asked = call_model(per.withColumn("prompt", F.concat(F.lit("Clean these entities and return JSON.\n"), F.to_json("items"))), factory, p.max_retries)
    answer = parse_lenient(F.col("response"), "items ARRAY<STRUCT<name: STRING, aliases: ARRAY<STRING>>>")
    return asked.select("entity_type", F.explode(F.coalesce(answer["items"], F.col("items"))).alias("e")).select("entity_type", "e.*")
