"""Entities: cleaning, merging, resolution across chapters, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.functions.similarity import alike, indel_ratio
from fablespark.params import DedupParams
from fablespark.runtime import cut, list_or_empty
from fablespark.schemas import TYPES

# --- Cleaning and validation -------------------------------------------------------------------------------------------------------


def named(entities: DataFrame) -> DataFrame:
    """Rows with a type and a name, both stripped; others are left out."""
    rows = entities.withColumn("name", tx.strip("name")).withColumn("entity_type", tx.strip("entity_type"))
    return rows.where("name <> '' AND entity_type <> ''")


def with_clean_aliases(entities: DataFrame) -> DataFrame:
    """Null aliases read as empty; blank and repeated ones left out, in order of code points."""
    shown = F.filter(F.transform(list_or_empty(F.col("aliases")), tx.strip), lambda a: a.isNotNull() & (a != ""))
    return entities.withColumn("aliases", F.array_sort(F.array_distinct(shown)))


def lightweight(entities: DataFrame, limit: int = 200, alias_limit: int = 30) -> DataFrame:
    """(entity_type, name, aliases) of the first entities of each type, with their first aliases."""
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy("name", "mention_id"))
    return entities.withColumn("_r", rank).where(F.col("_r") <= limit).select("entity_type", "name", F.slice("aliases", 1, alias_limit).alias("aliases"))


def validation_errors(entities: DataFrame, descriptive: list[str]) -> DataFrame:
    """The rows with ``errors``: what is missing of type, name and every descriptive field."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    nothing = F.lit(True)
    for c in descriptive:
        nothing = nothing & empty(c)
    checks = [
        F.when(empty("entity_type"), "no entity_type"),
        F.when(~F.coalesce(F.col("entity_type").isin(TYPES), F.lit(False)) & ~empty("entity_type"), F.concat(F.lit("unknown type "), F.col("entity_type"))),
        F.when(empty("name"), "no name"),
        F.when(nothing, "no descriptive field"),
    ]
    return entities.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


# --- Merging -----------------------------------------------------------------------------------------------------------------------


def longest_first(value: str, order: Column) -> Column:
    """The longest string of a group; of equals the first by ``order``."""
    return F.max_by(value, F.struct(F.length(value), -order))


def longest_last(value: str, order: Column) -> Column:
    """The longest string of a group; of equals the last by ``order``."""
    return F.max_by(value, F.struct(F.length(value), order))


def merge_groups(rows: DataFrame, keys: list[str], order: str, strings: list[str] = (), chapters: str | None = "source_chapters", records: list[str] = ()) -> DataFrame:
    """One entity per key: name the longest (first of equals), aliases all aliases and names but that one, string fields the
    longest (last of equals), chapters united, lists of ``records`` (arrays of structs) united with equal records once, in order.
    ``order`` is a numeric column without ties; null arrays count as empty.
    """
    o = F.col(order)
    aliases = F.flatten(F.collect_set(F.concat(list_or_empty(F.col("aliases")), F.array("name"))))
    columns = [longest_first("name", o).alias("name"), aliases.alias("_a"), F.count("*").alias("members")]
    columns += [longest_last(c, o).alias(c) for c in strings]
    if chapters:
        columns.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(list_or_empty(F.col(chapters), "array<int>"))))).alias(chapters))
    for c in records:
        columns.append(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(list_or_empty(F.col(c), rows.schema[c].dataType.simpleString()))), lambda r: r.isNotNull()))).alias(c))
    out = rows.groupBy(*keys).agg(*columns)
    kept = F.array_sort(F.array_distinct(F.filter("_a", lambda a: a.isNotNull() & (a != F.col("name")))))
    return out.withColumn("aliases", kept).drop("_a")


def merge_within_chapter(entities: DataFrame, strings: list[str] = ("description",)) -> DataFrame:
    """Entities of one chapter with the same type and the same name (case and outer blanks ignored) as one."""
    rows = named(entities).withColumn("_key", tx.normalise("name"))
    return merge_groups(rows, ["book_num", "chapter_num", "entity_type", "_key"], "mention_id", list(strings)).drop("_key")


def merge_raw(entities: DataFrame, keys: list[str], order: str, least: float | None = 0.85) -> DataFrame:
    """Raw entities of one key (type and name, case kept) as one: descriptions and aliases as lists.

    A later value is appended only if it is not alike to one kept already; the first row's values are taken as they are. With
    ``least`` None values are compared for equality only.
    """
    names = F.struct(F.col(order).alias("o"), F.col("description").alias("d"), list_or_empty(F.col("aliases")).alias("a"))
    grouped = entities.groupBy(*keys).agg(F.array_sort(F.collect_list(names)).alias("rows"))
    if least is None:
        texts = F.array_distinct(F.filter(F.transform("rows", lambda r: r["d"]), lambda d: d.isNotNull()))
        return grouped.select(*keys, texts.alias("description"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["a"]))).alias("aliases"))

    def keep(kept: list[str], more: list[str], first: bool) -> list[str]:
        for x in more:
            if first or not any(alike(x, y, least) for y in kept):
                kept.append(x)
        return kept

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            texts, aliases = [], []
            for rows in batch["rows"]:
                d: list[str] = []
                a: list[str] = []
                for k, r in enumerate(rows):
                    d = keep(d, [r["d"]] if r["d"] else [], k == 0)
                    a = keep(a, [x for x in r["a"] if x], k == 0)
                texts.append(d)
                aliases.append(a)
            yield out.assign(description=texts, aliases=aliases)

    kinds = ", ".join(f"{c} {entities.schema[c].dataType.simpleString()}" for c in keys)
    return grouped.mapInPandas(merge, f"{kinds}, description array<string>, aliases array<string>")


def merge_aliases(existing: Column, new: Column) -> Column:
    """Aliases of both sides, one per spelling regardless of case; the existing spelling wins, of one side the last."""
    side = lambda c, rank: F.transform(F.filter(list_or_empty(c), lambda a: F.trim(a) != ""), lambda a, i: F.struct(tx.normalise(a).alias("k"), F.lit(rank).alias("side"), i.alias("i"), a.alias("a")))
    rows = F.concat(side(existing, 1), side(new, 0))
    best = F.filter(rows, lambda r: ~F.exists(rows, lambda x: (x["k"] == r["k"]) & ((x["side"] > r["side"]) | ((x["side"] == r["side"]) & (x["i"] > r["i"])))))
    return F.array_sort(F.transform(best, lambda r: r["a"]))


def upsert(accumulated: DataFrame, new: DataFrame) -> DataFrame:
    """(entity_type, name, aliases): entities of equal type and name with the aliases of both, in order of code points."""
    both = accumulated.select("entity_type", "name", "aliases").unionByName(new.select("entity_type", "name", "aliases"))
    return both.groupBy("entity_type", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(list_or_empty(F.col("aliases")))))).alias("aliases"))


def consolidate_relationships(relationships: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, relationships): per target the sorted set of relationships, targets in order; rows with an empty side are left out."""
    pairs = relationships.where("length(trim(entity)) > 0 AND length(trim(relationship)) > 0")
    per = pairs.groupBy(*owner, "entity").agg(F.array_sort(F.collect_set("relationship")).alias("relationships"))
    return per.groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("entity", "relationships"))).alias("relationships"))


def group_members(entities: DataFrame, by: str, member: str, chapters: str) -> DataFrame:
    """(by, members, chapters): distinct members and chapters of each value, in order; null values are left out."""
    return entities.where(F.col(by).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set(member)).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(list_or_empty(F.col(chapters), "array<int>"))))).alias("chapters"))


# --- Resolution --------------------------------------------------------------------------------------------------------------------


def needed_ratio(p: DedupParams, a: Column, b: Column) -> Column:
    """Least ratio for two names: stricter for short ones."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter <= p.short_length, p.ratio_short).when(shorter <= p.middle_length, p.ratio_middle).otherwise(p.ratio)


def resolution_edges(entities: DataFrame, keys: list[str], p: DedupParams = DedupParams()) -> DataFrame:
    """(u, v) of distinct entities (column ``id``, a string) of the same keys that are the same by name, alias or ratio.

    Equal names and shared aliases, or a name among the other's aliases, meet through the smallest id that has the string. Other
    pairs of names are compared only where they share a rare bigram, which names of a sufficient ratio do.
    """
    own = entities.select("id", *keys, tx.normalise("name").alias("_n"), F.transform(list_or_empty(F.col("aliases")), tx.normalise).alias("_a"))
    strings = own.select("id", *keys, F.explode(F.array_distinct(F.concat(F.array("_n"), "_a"))).alias("_s")).where("_s <> ''")
    hub = F.min("id").over(Window.partitionBy(*keys, "_s"))
    exact = strings.select(F.col("id").alias("u"), hub.alias("v")).where("u <> v")
    names = cut(own.where("_n <> ''").groupBy(*keys, "_n").agg(F.min("id").alias("id")))
    a, b = names.select(*keys, F.col("_n").alias("_n1"), F.col("id").alias("u")), names.select(*keys, F.col("_n").alias("_n2"), F.col("id").alias("v"))
    pairs = _name_candidates(names, keys, p).join(a, [*keys, "_n1"]).join(b, [*keys, "_n2"])
    fuzzy = pairs.withColumn("_r", indel_ratio("_n1", "_n2")).where(F.col("_r") >= needed_ratio(p, F.col("_n1"), F.col("_n2"))).select("u", "v")
    return exact.unionByName(fuzzy).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _name_candidates(names: DataFrame, keys: list[str], p: DedupParams) -> DataFrame:
    """(keys, n1, n2), n1 before n2, of the pairs of names that could reach the ratio: a prefix filter over bigrams.

    Of names that reach the ratio only some bigrams differ, so if bigrams are taken from the rarest on, one of the first few is
    common to both. Nothing that reaches the ratio is lost.
    """
    least = p.ratio - 0.5  # ratios are rounded
    # Bigrams that are not in order can be lost two per letter: for ratio r of names with a + b letters at most
    # (a + b)(1 - r) letters are unmatched, each in at most two bigrams.
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_n") - 1, F.lit(1))), lambda i: F.substring(F.col("_n"), i, F.lit(2)))
    nth = F.transform("_g", lambda x, i: F.struct(x.alias("_gram"), F.size(F.filter(F.slice("_g", 1, i + 1), lambda y: y == x)).alias("_nth")))
    listed = names.select(*keys, "_n", F.length("_n").alias("_len"), grams.alias("_g")).select("*", nth.alias("_t"))
    counted = listed.select(*keys, "_n", "_len", F.size("_g").alias("_m"), F.explode("_t").alias("_t")).select(*keys, "_n", "_len", "_m", "_t.*")
    frequency = counted.groupBy(*keys, "_gram", "_nth").agg(F.count("*").alias("_f"))
    ranked = counted.join(frequency, [*keys, "_gram", "_nth"]).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_n").orderBy("_f", "_gram", "_nth")))
    # The partner is at most len (2 - r) / r long, so at most 2 len (1 - r) / r letters of both are unmatched.
    unmatched = F.floor(F.col("_len") * 2 * (100 - least) / least)
    prefix = ranked.where((F.col("_rank") <= 2 * unmatched + 1) | (F.col("_m") <= 2 * unmatched))
    short = prefix.where(F.col("_m") <= 2 * unmatched).select(*keys, "_n", "_len").distinct()
    side = lambda df, k, *more: df.select(*keys, *more, F.col("_n").alias(f"_n{k}"), F.col("_len").alias(f"_len{k}"))
    near = (F.least("_len1", "_len2") * (200 - least) >= F.greatest("_len1", "_len2") * least) & (F.col("_n1") < F.col("_n2"))
    met = side(prefix, 1, "_gram", "_nth").join(side(prefix, 2, "_gram", "_nth"), [*keys, "_gram", "_nth"]).where(near).select(*keys, "_n1", "_n2")
    # Names too short for a common bigram to be sure meet by their keys; names of two or three letters are few.
    few = side(short, 1).join(side(short, 2), keys).where(near).select(*keys, "_n1", "_n2")
    return met.unionByName(few).distinct()


def components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, component) of the vertices of edges (u, v): the smallest id that a path leads to.

    Each round takes the least label among the neighbours and then the label of that label, so the rounds grow with the
    logarithm of the longest path; every round is checkpointed.
    """
    both = cut(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "id"))
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"), "c")
        # A vertex also tells its label what it has seen, so that trees are joined at their roots.
        told = seen.join(labels.withColumnRenamed("c", "own"), "id").select(F.col("own").alias("id"), "c")
        better = labels.unionByName(seen).unionByName(told).groupBy("id").agg(F.min("c").alias("c"))
        jumped = better.join(better.toDF("c", "next"), "c").select("id", F.least("c", "next").alias("c"))
        after = cut(jumped)
        if after.join(labels.withColumnRenamed("c", "old"), "id").where("c <> old").isEmpty():
            return labels.withColumnRenamed("c", "component")
        labels = after
    raise RuntimeError("components did not settle")


def resolve_entities(entities: DataFrame, keys: list[str] = ("book_num", "entity_type"), p: DedupParams = DedupParams(), strings: list[str] = ("description",)) -> DataFrame:
    """Entities of all chapters of the same keys as one per cluster, merged.

    ``entities`` has (id string, order long, name, aliases, source_chapters, keys). Ties of length go by ``order``.
    """
    keys = list(keys)
    edges = resolution_edges(entities, keys, p)
    found = components(edges)
    rows = entities.join(found, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    return merge_groups(rows, [*keys, "cluster"], "order", list(strings))


# --- Reports -----------------------------------------------------------------------------------------------------------------------


def counts_by_chapter(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Entities per chapter and type as a wide table, zeros filled, with the sum over all types."""
    wide = entities.groupBy(*keys).pivot("entity_type", TYPES).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0)))


def counts_with_total(entities: DataFrame, key: str) -> DataFrame:
    """``counts_by_chapter`` for one key and a row with key null for all."""
    columns = [F.count_if(F.col("entity_type") == t).alias(t) for t in TYPES]
    return entities.rollup(key).agg(F.grouping_id().alias("is_total"), *columns, F.count_if(F.col("entity_type").isin(TYPES)).alias("total"))


def dedup_report(raw: DataFrame, within: DataFrame, final: DataFrame) -> DataFrame:
    """Per type, and over all with entity_type null and is_total 1: raw, after chapters, final, merged, reduction in percent, averages of chapters and aliases."""
    n = lambda df, c: df.rollup("entity_type").agg(F.grouping_id().alias("is_total"), F.count("*").alias(c)).na.fill("", ["entity_type"])
    more = final.rollup("entity_type").agg(
        F.grouping_id().alias("is_total"),
        F.count("*").alias("final"),
        F.round(F.avg(F.size("source_chapters")), 6).alias("avg_chapters"),
        F.sum(F.size("aliases")).alias("total_aliases"),
        F.round(F.avg(F.size("aliases")), 6).alias("avg_aliases"),
    )
    key = ["entity_type", "is_total"]
    out = n(raw, "raw").join(n(within, "within"), key, "left").join(more.na.fill("", ["entity_type"]), key, "left").na.fill(0, ["within", "final"])
    return out.select(F.when(F.col("is_total") == 0, F.col("entity_type")).alias("entity_type"), "is_total", "raw", (F.col("raw") - F.col("within")).alias("removed_within"), (F.col("within") - F.col("final")).alias("merged_across"), "final", F.round(F.try_divide(100.0 * (F.col("raw") - F.col("final")), F.col("raw")), 2).alias("reduction_pct"), "avg_chapters", "total_aliases", "avg_aliases")


def entity_summary(entities: DataFrame) -> DataFrame:
    """(name, aliases, chapters, mentions) of merged entities in order of name."""
    return entities.select("name", F.size("aliases").alias("aliases"), F.size("source_chapters").alias("chapters"), "members").orderBy("name")


def entities_where(entities: DataFrame, name: str | None = None, chapter: int | None = None) -> DataFrame:
    """The rows of a name (case and outer blanks ignored) or of a chapter, or of both."""
    out = entities if name is None else entities.where(tx.normalise("name") == tx.normalise(F.lit(name)))
    return out if chapter is None else out.where(F.col("chapter_num") == chapter)


def by_type(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entities): per key a map from type to its names in order, the nested form of the rows."""
    per = entities.groupBy(*keys, "entity_type").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "names")))).alias("entities"))


def entity_listing(entities: DataFrame) -> DataFrame:
    """(entity_type, name, also): entities in order of type and name, aliases joined."""
    return entities.select("entity_type", "name", F.array_join("aliases", ", ").alias("also")).orderBy("entity_type", "name")
