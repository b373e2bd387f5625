"""Scenes from the similarity of consecutive chunks; all window functions over one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.functions import text as tx
from fablespark.functions.vectors import cosine
from fablespark.params import SceneProfile


def consecutive_similarity(chunks: DataFrame, keys: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """The rows with ``sim``, the cosine similarity to the next chunk of their key; null for the last, and for vectors without length."""
    following = F.lead(vector).over(Window.partitionBy(*keys).orderBy(order))
    return chunks.withColumn("sim", cosine(F.col(vector), following))


def similarity_profile(similarities: DataFrame, keys: list[str], sim: str = "sim") -> DataFrame:
    """Mean, population deviation, quartiles and range of the similarities of each key, with the thresholds derived from them."""
    out = similarities.where(F.col(sim).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(sim).alias("mean"),
        F.stddev_pop(sim).alias("std"),
        F.min(sim).alias("least"),
        F.max(sim).alias("greatest"),
        F.percentile(sim, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
    )
    mean, std = F.col("mean"), F.col("std")
    values = {"mean": mean, "std": std, "least": F.col("least"), "greatest": F.col("greatest"), "p25": F.col("q")[0], "median": F.col("q")[1], "p75": F.col("q")[2], "spread": F.col("greatest") - F.col("least")}
    values |= {"conservative_threshold": mean - 0.5 * std, "moderate_threshold": mean - std, "aggressive_threshold": F.col("q")[0], "conservative_drop": 0.5 * std, "moderate_drop": std, "strong_drop": 1.5 * std}
    return out.select(*keys, "n", *[F.round(v, 6).alias(k) for k, v in values.items()])


def _thresholds(p: SceneProfile, w: Window, sim: str) -> tuple[Column, Column, Column]:
    """(threshold, least drop, strong drop), fixed or from the similarities of the key."""
    if p.strategy == "fixed":
        return F.lit(p.threshold), F.lit(p.min_drop), F.lit(p.strong_drop)
    mean, std = F.avg(sim).over(w), F.stddev_pop(sim).over(w)
    at, drop = {
        "conservative": (mean - 0.5 * std, 0.5 * std),
        "moderate": (mean - std, std),
        "aggressive": (F.percentile(sim, F.lit(0.25)).over(w), std),
    }[p.strategy]
    return at, drop, 1.5 * std


def mark_boundaries(similarities: DataFrame, keys: list[str], order: str, p: SceneProfile = SceneProfile(), sim: str = "sim") -> DataFrame:
    """The rows with ``valley``: whether a scene ends after this chunk.

    A similarity is a valley if it is a local minimum at or below the threshold with at least the least drop, or has the strong drop
    at or below the threshold, and does not rise by more than the recovery right after. The first and the last never are.
    """
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    s, before, after = F.col(sim), F.lag(sim).over(w), F.lead(sim).over(w)
    at, least, strong = _thresholds(p, part, sim)
    drop = before - s
    cut = (((s < before) & (s < after) & (s <= at) & (drop >= least)) | ((drop >= strong) & (s <= at))) & ~(after - s > p.recovery)
    return similarities.withColumn("valley", F.coalesce(cut, F.lit(False)))


def number_scenes(marked: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows with ``scene_number`` from 1: a scene begins at the chunk after a valley."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = marked.withColumn("_starts", F.coalesce(F.lag("valley").over(w), F.lit(False)).cast("int"))
    return starts.withColumn("scene_number", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int") + 1).drop("_starts")


def build_scenes(numbered: DataFrame, keys: list[str], order: str, p: SceneProfile = SceneProfile(), text: str | None = None, tokens: str | None = None, chunk: str | None = None, sim: str = "sim") -> DataFrame:
    """One row per scene: chunks in order, text joined by spaces, tokens, average and least similarity inside the scene.

    Similarities across a boundary don't count; a scene of one chunk has 0. With ``drop_short`` keys of fewer than two chunks have
    no scenes.
    """
    inside = F.when(~F.col("valley"), F.col(sim))
    columns = [F.count("*").alias("num_chunks"), F.coalesce(F.avg(inside), F.lit(0.0)).alias("avg_similarity"), F.coalesce(F.min(inside), F.lit(0.0)).alias("min_similarity")]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("x")))), lambda v: v["x"])
    if chunk:
        columns.append(ordered(chunk).alias("chunk_ids"))
    if text:
        columns.append(F.array_join(ordered(text), " ").alias("text"))
    if tokens:
        columns.append(F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("tokens"))
    scenes = numbered.groupBy(*keys, "scene_number").agg(*columns)
    if p.drop_short:
        scenes = scenes.withColumn("_n", F.sum("num_chunks").over(Window.partitionBy(*keys))).where("_n >= 2").drop("_n")
    return scenes


def detect_scenes(chunks: DataFrame, keys: list[str], order: str, p: SceneProfile = SceneProfile(), vector: str = "embedding", **columns: str) -> DataFrame:
    """Scenes of chunks with vectors: similarity, valleys, numbering and aggregation over a single exchange."""
    marked = mark_boundaries(consecutive_similarity(chunks, keys, order, vector), keys, order, p)
    return build_scenes(number_scenes(marked, keys, order), keys, order, p, **columns)


def scene_lists(scenes: DataFrame, keys: list[str], tokens: str = "tokens", chunks: str = "num_chunks") -> DataFrame:
    """(keys, scenes, scene_tokens, boundaries, avg_tokens): per chapter the tokens of its scenes in order and after which of its chunks scenes end."""
    rows = scenes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("scene_number", F.col(tokens).alias("t"), F.col(chunks).alias("n")))).alias("s"))
    ends = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0).cast("long"), lambda acc, y: acc + y["n"]))
    return rows.select(*keys, F.size("s").alias("scenes"), F.transform("s", lambda x: x["t"]).alias("scene_tokens"), F.slice(ends, 1, F.size("s") - 1).alias("boundaries"), F.round(F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x["t"]) / F.size("s"), 6).alias("avg_tokens"))


def scene_report(scenes: DataFrame, key: str) -> DataFrame:
    """Scenes, chunks, sizes and similarities per key, and a total row with key null; every row has all columns."""
    return scenes.rollup(key).agg(
        F.grouping_id().alias("is_total"),
        F.count("*").alias("scenes"),
        F.sum("num_chunks").alias("chunks"),
        F.round(F.avg("num_chunks"), 6).alias("avg_chunks"),
        F.min("num_chunks").alias("min_chunks"),
        F.max("num_chunks").alias("max_chunks"),
        F.round(F.avg("avg_similarity"), 6).alias("avg_similarity"),
        F.round(F.min("min_similarity"), 6).alias("min_similarity"),
    )


def chunk_triples(chunks: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each chunk with the two after it, as columns ``first_``, ``second_`` and ``third_``; n chunks give n - 2 rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = [F.lead(c, k).over(w).alias(f"{name}_{c}") for k, name in ((1, "second"), (2, "third")) for c in columns]
    there = F.lead(F.lit(1), 2).over(w).alias("_there")
    return chunks.select(*keys, *[F.col(c).alias(f"first_{c}") for c in columns], *ahead, there).where("_there = 1").drop("_there")


def scenes_by_answers(chunks: DataFrame, keys: list[str], order: str, same_scene: Column) -> DataFrame:
    """The rows with ``scene_number`` where a backend has said of chunks i and i+1 whether they are one scene.

    ``same_scene`` is its answer on the row of chunk i; keys need three chunks, and the last pair is never asked.
    """
    part = Window.partitionBy(*keys)
    w = part.orderBy(order)
    asked = F.lead(F.lit(1), 2).over(w).isNotNull()
    marked = chunks.withColumn("valley", asked & ~F.coalesce(same_scene, F.lit(True)))
    return number_scenes(marked, keys, order)


def similarity_series(marked: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, position, sim, valley): the series behind a similarity plot."""
    w = Window.partitionBy(*keys).orderBy(order)
    return marked.where("sim IS NOT NULL").select(*keys, F.row_number().over(w).alias("position"), F.round("sim", 6).alias("sim"), "valley")


def named_scenes(scenes: DataFrame, book: str, chapter: str) -> DataFrame:
    """Scenes with their identifier."""
    return scenes.withColumn("scene_id", tx.scene_id(F.col(book), F.col(chapter), F.col("scene_number")))
