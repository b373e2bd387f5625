"""Retrieval over chunks: dense and lexical ranking, fusion, neighbours, scenes, metrics, and paths in the event graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.operators.mentions import text_words
from fablespark.runtime import cut, small_rows


def dense_top_k(chunks: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", chunk_id: str = "vec_id") -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k most similar chunks for each query (query_id, query_vector).

    The queries are a stated set of checked size that goes to every task. Each batch of chunks meets them in one matrix product and keeps its k
    best per query, and all that tie with the last of these, before the shuffle. Null vectors, those of another length and
    those without direction have no similarity.
    """
    stated = small_rows(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")))
    asked = [(r["query_id"], np.array(r["v"])) for r in stated if r["v"] and any(r["v"])]
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{chunk_id}` {chunks.schema[chunk_id].dataType.simpleString()}, score double"
    if not asked:
        return rank_hits(chunks.sparkSession.createDataFrame([], kinds), k, chunk_id)
    blocks = {n: ([q for q, v in asked if len(v) == n], np.stack([v / np.linalg.norm(v) for _, v in asked if len(v) == n], axis=1)) for n in {len(v) for _, v in asked}}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for n, (ids, unit) in blocks.items():
                own = np.flatnonzero(sizes == n)
                if not len(own):
                    continue
                matrix = np.stack(batch["v"].to_numpy()[own])
                length = np.linalg.norm(matrix, axis=1)
                own, matrix, length = own[length > 0], matrix[length > 0], length[length > 0]
                if not len(own):
                    continue
                scores = np.round((matrix / length[:, None]) @ unit, 6)
                least = np.partition(scores, max(0, len(own) - k), axis=0)[max(0, len(own) - k)]
                row, query = np.nonzero(scores >= least)
                yield pd.DataFrame({"query_id": [ids[q] for q in query], chunk_id: batch[chunk_id].to_numpy()[own[row]], "score": scores[row, query]})

    rows = chunks.select(chunk_id, F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    return rank_hits(rows.mapInPandas(score, kinds), k, chunk_id)


def embed_texts(texts: DataFrame, factory: Callable, text: str, vector: str) -> DataFrame:
    """The rows with the vector of their whole text; the model has ``embed`` and is made once per task."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield batch.assign(**{vector: list(model.embed(batch[text].tolist()))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(embed, f"{schema}, `{vector}` array<double>")


def rank_hits(scored: DataFrame, k: int, chunk_id: str) -> DataFrame:
    """The k best of each query, ties by chunk; the limit on the rank is pushed below the shuffle by the planner."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), chunk_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", chunk_id, "score", "rank")


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(word, key, tf, length): the inverted index of the texts."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")
    split = texts.select(key, words.alias("w"))  # a step of its own: what stands beside explode is computed for each word
    rows = split.select(key, F.size("w").alias("length"), F.explode("w").alias("word"))
    return rows.groupBy("word", key, "length").agg(F.count("*").alias("tf"))


def bm25_top_k(texts: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank) by BM25 for queries (query_id, query); texts without a word of the query are not ranked."""
    rows = texts.where(F.col("text").isNotNull()).select(key, "text").dropDuplicates([key])
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")
    listed = rows.select(key, words.alias("w")).select(key, F.size("w").alias("length"), "w")
    size = listed.agg(F.count("*").cast("double").alias("docs"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("mean"))
    docs, mean = size.select("docs").scalar(), size.select("mean").scalar()
    asked = text_words(queries, ["query_id"], "query")
    # Only words that are asked for become postings.
    index = listed.select(key, "length", F.explode("w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("word", key, "length").agg(F.count("*").alias("tf"))
    frequency = index.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / mean)
    scored = index.join(asked, "word").join(frequency, "word").groupBy("query_id", key).agg(F.round(F.sum(idf * F.col("tf") * (k1 + 1) / norm), 6).alias("score"))
    return rank_hits(scored, k, key)


def fuse(rankings: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Rankings united by the sum of 1 / (constant + rank)."""
    both = rankings[0].select("query_id", key, "rank")
    for other in rankings[1:]:
        both = both.unionByName(other.select("query_id", key, "rank"))
    return rank_hits(both.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score")), k, key)


def layered_top_k(rankings: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """(query_id, layer, id, rank): the best of several layers, each with its own number of results."""
    frames = [r.where(F.col("rank") <= n).select("query_id", F.lit(layer).alias("layer"), F.col(key).cast("string").alias("id"), "rank") for layer, (r, key, n) in rankings.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rerank(candidates: DataFrame, factory: Callable[[], Callable[[str, str], float]], key: str, k: int) -> DataFrame:
    """Candidates (query_id, key, query, text) scored anew by a model of pairs, the k best of each query kept."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield batch[["query_id", key]].assign(score=[float(model(q, t)) for q, t in zip(batch["query"], batch["text"])])

    kinds = [f"{c} {candidates.schema[c].dataType.simpleString()}" for c in ("query_id", key)]
    return rank_hits(candidates.mapInPandas(score, f"{', '.join(kinds)}, score double"), k, key)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, keys: list[str], order: str, chunk_id: str, n: int = 1, extra: list[str] = ()) -> DataFrame:
    """(extra, keys, order, chunk_id): the hits with up to n chunks before and after, each once.

    Each hit names the places around it, so the chunks are found by an equi-join.
    """
    at = hits.join(chunks.select(chunk_id, *keys, order), chunk_id).select(*extra, *keys, F.explode(F.sequence(F.col(order) - n, F.col(order) + n)).alias(order)).distinct()
    return chunks.select(*keys, order, chunk_id).join(at, [*keys, order]).select(*extra, *keys, order, chunk_id).distinct()


def complete_scenes(hits: DataFrame, scenes: DataFrame, chunk_id: str = "chunk_id", least: int = 2) -> DataFrame:
    """(scene_id, hits) of the scenes that hold at least ``least`` of the hit chunks."""
    members = scenes.select("scene_id", F.explode("chunk_ids").alias(chunk_id)).distinct()
    return members.join(hits.select(chunk_id).distinct(), chunk_id).groupBy("scene_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def retrieval_metrics(ranking: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and normalised gain at k per query that has relevant rows."""
    good = relevant.select("query_id", key).distinct().withColumn("good", F.lit(1))
    per = good.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranking.where(F.col("rank") <= k).join(good, ["query_id", key])
    found = hits.groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("gain"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n", F.lit(k))), lambda i: 1 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    out = per.join(found, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", zero(F.col("h") / F.col("n")).alias("recall"), zero(F.col("h") / F.lit(k)).alias("precision"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("gain") / ideal).alias("ndcg"))


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, steps) of all nodes that edges (src, dst) lead to from the start nodes, with the fewest edges.

    Breadth first until nothing new is reached: each step joins only the nodes that were reached last and is checkpointed.
    """
    reached = cut(start.select(F.col("node"), F.lit(0).alias("steps")).distinct())
    front = reached
    for step in count(1):
        found = edges.join(front, edges["src"] == front["node"]).select(F.col("dst").alias("node")).distinct()
        front = cut(found.join(reached, "node", "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)


def theme_index(texts: DataFrame, key: str, themes: dict[str, list[str]]) -> DataFrame:
    """(theme, key, hits): how many words of each theme a text has."""
    words = [(theme, w.lower()) for theme, listed in themes.items() for w in listed]
    table = texts.sparkSession.createDataFrame(words, "theme string, word string")
    return postings(texts, key).join(table, "word").groupBy("theme", key).agg(F.sum("tf").alias("hits"))


def route_query(query: Column) -> Column:
    """Type of a question by its words: causal, temporal, relationship, summary, or factual."""
    low = F.lower(query)
    return (
        F.when(low.rlike("\\b(why|because|cause[ds]?|lead|led)\\b"), "causal")
        .when(low.rlike("\\b(when|before|after|first|last|until)\\b"), "temporal")
        .when(low.rlike("\\b(between|relationship|with whom|friend|enemy)\\b"), "relationship")
        .when(low.rlike("\\b(summar\\w+|overview|about|theme)\\b"), "summary")
        .otherwise("factual")
    )


def grounded(claims: DataFrame, texts: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """(claim_id, share, grounded): the share of a claim's words that its cited text (key) has."""
    asked = text_words(claims, ["claim_id", key], "claim")
    total = asked.groupBy("claim_id").agg(F.count("*").alias("n"))
    have = asked.join(text_words(texts, [key]).distinct(), [key, "word"]).groupBy("claim_id").agg(F.count("*").alias("h"))
    share = F.coalesce(F.col("h"), F.lit(0)) / F.col("n")
    return total.join(have, "claim_id", "left").select("claim_id", F.round(share, 6).alias("share"), (share >= least).alias("grounded"))
