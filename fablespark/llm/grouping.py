"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every round draws an exponential start time for each vertex, lets clusters grow from the early starters along
the edges, contracts each cluster to one super-vertex and goes on with the edges between clusters. The vertex-to-cluster
tables of the rounds are composed at the end. All state is in DataFrames; the driver only learns whether edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fablespark.runtime import cleaned, cut, list_or_empty


def record_links(entities: DataFrame, matches: DataFrame, rows_per_hub: int = 500_000) -> DataFrame:
    """Links ``(u, v)``, u < v and perhaps repeated, between records of entities_raw.

    Records of one book and type that share a cleaned string (name or alias) are linked through the smallest
    ``mention_id`` that has the string, never pair by pair: within sub-groups first, then between the sub-groups. There are
    so many sub-groups that even a string held by all records has at most about ``rows_per_hub`` in each, so no string is
    a single task's work and no hub has more neighbours. To these come the pairs that ``matches`` calls ``same`` in either order.

    Null book, type or mention_id, null or blank strings, self-matches and matches with a missing or unknown id link
    nothing; repeated rows count once.
    """
    records = entities.where("mention_id IS NOT NULL").select("mention_id", "book_num", "entity_type", "name", "aliases")
    salts = 1 + records.count() // rows_per_hub
    strings = F.concat(F.array("name"), list_or_empty(F.col("aliases")))
    keys = (
        records.where("book_num IS NOT NULL AND entity_type IS NOT NULL")
        .select("mention_id", "book_num", "entity_type", F.explode(F.array_distinct(F.transform(strings, cleaned))).alias("key"))
        .where("key IS NOT NULL")
        .select(F.col("mention_id").alias("a"), "book_num", "entity_type", "key", F.pmod(F.xxhash64("mention_id"), F.lit(salts)).alias("salt"))
    )
    group = ["book_num", "entity_type", "key"]
    within = keys.withColumn("b", F.min("a").over(Window.partitionBy(*group, "salt")))
    links = within.select("a", "b")
    if salts > 1:  # the hubs of the sub-groups
        hubs = within.where("a = b").select("a", *group).distinct()
        links = links.unionByName(hubs.select("a", F.min("a").over(Window.partitionBy(*group)).alias("b")))
    ids = records.select(F.col("mention_id").alias("id"))
    same = matches.where("decision = 'same' AND left_id <> right_id").select(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()
    same = same.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")
    return links.unionByName(same).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _shift(vertex: Column, seed: int, beta: float) -> Column:
    """An exponential variate of rate beta from a hash, the same wherever and whenever it is computed."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(seed)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
    return -F.log(uniform) / beta


def _arcs(pairs: DataFrame) -> DataFrame:
    """(src, dst, step) of the distinct pairs (a, b) in both directions, step 1, and of every vertex to itself, step 0; lineage is cut."""
    way = lambda a, b, n: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(n).alias("step"))
    return cut(pairs.where("a <> b").select(F.inline(F.array(way("a", "b", 1), way("b", "a", 1), way("a", "a", 0), way("b", "b", 0)))).distinct())


def _decompose(arcs: DataFrame, seed: int, beta: float, hops_at_once: int) -> DataFrame:
    """(id, centre): a vertex joins the centre c with the largest shift(c) - distance(c, vertex).

    Clusters grow hop by hop until no vertex changes its centre, so each reaches as far as its start time lets it; whether
    any has changed is asked, and lineage cut, once in ``hops_at_once`` hops. The arcs are shuffled once and lie by their source; a hop
    shuffles what the vertices are told, combined before, and nothing else.
    """
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = arcs.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)  # lost parts come from the checkpoint of the arcs
    # The first hop needs no join: what a vertex tells its neighbours follows from its own id.
    label = _best(placed, _shift(F.col("src"), seed, beta), F.col("src"))
    for hops in count(1):
        if hops % hops_at_once == 0:
            label = cut(label)
            if label.where("changed").isEmpty():
                placed.unpersist()
                return label.select("id", "centre")
        label = _best(placed.join(label.select("id", "value", "centre").hint("shuffle_hash"), F.col("src") == F.col("id")), F.col("value"), F.col("centre"))


def _best(arcs: DataFrame, value: Column, centre: Column) -> DataFrame:
    """(id, value, centre, changed): the best of what the arcs bring to each vertex, and whether that is better than what it had.

    Of equal values any centre will do: it is of the same component.
    """
    brought = value - F.col("step")
    merged = arcs.groupBy(F.col("dst").alias("id")).agg(F.max(brought).alias("value"), F.max_by(centre, brought).alias("centre"), F.max(F.when(F.col("step") == 0, value)).alias("had"))
    return merged.select("id", "value", "centre", (F.col("value") > F.col("had")).alias("changed"))


def _closure(arcs: DataFrame) -> DataFrame:
    """(id, centre) of a graph of few arcs, in one task: the centre is the smallest id of the component."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["src"].tolist(), batch["dst"].tolist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pd.DataFrame({"id": ids, "centre": [root(x) for x in ids]}, dtype=None if ids else "int64")

    kind = arcs.schema["src"].dataType.simpleString()
    return cut(arcs.select("src", "dst").repartition(1).mapInPandas(close, f"id {kind}, centre {kind}"))


def connected_groups(edges: DataFrame, beta: float = 0.6, hops_at_once: int = 3, seed: int = 11, base_arcs: int = 10_000) -> DataFrame:
    """(id, group_id) for every vertex of ``edges`` (columns u, v); group_id is the smallest id of its component.

    ``beta`` is the rate of the start-time shifts: about that share of the edges is left between clusters after a round, and a
    cluster of n vertices has a radius of about ln(n) / beta at most. The recursion ends in a graph of ``base_arcs`` arcs (four to a pair) at
    most, which one task closes. Pairs may be repeated and in either order; null ids and pairs of an
    id with itself are left out. An empty edge table gives an empty result.
    """
    tables: list[DataFrame] = []
    current = _arcs(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b")))
    none = current.select(F.col("src").alias("id"), F.col("src").alias("group_id")).limit(0)
    while left := current.count():
        if left <= base_arcs:
            tables.append(_closure(current))
            break
        own = _decompose(current, seed + len(tables), beta, hops_at_once)
        tables.append(own)
        between = current.where("src < dst").join(own.toDF("src", "a"), "src").join(own.toDF("dst", "b"), "dst")
        current = _arcs(between.select("a", "b"))
    if not tables:
        return none
    first = tables[0]
    # Roots of the first round's centres, composed from the smallest table upwards; only the last join has full size.
    root = None
    for own in reversed(tables[1:]):
        step = own.toDF("id", "mid")
        if root is None:
            root = step.withColumnRenamed("mid", "root")
        else:
            root = step.join(root.toDF("mid", "root"), "mid", "left").select("id", F.coalesce("root", "mid").alias("root"))
    least = first.groupBy("centre").agg(F.min("id").alias("least"))
    if root is not None:
        least = least.join(root.withColumnRenamed("id", "centre"), "centre", "left").select("centre", "least", F.coalesce("root", "centre").alias("root"))
        smallest = least.groupBy("root").agg(F.min("least").alias("group_id"))
        least = least.join(smallest, "root").select("centre", "group_id")
    else:
        least = least.withColumnRenamed("least", "group_id")
    return first.join(least, "centre").select("id", "group_id")


def group_records(entities: DataFrame, matches: DataFrame, **parameters) -> DataFrame:
    """(mention_id, group_id) for each record that is linked to another one, directly or through others."""
    return connected_groups(record_links(entities, matches), **parameters).withColumnRenamed("id", "mention_id")
