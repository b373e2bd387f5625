import random

from pyspark.sql import functions as F

from fablespark.llm.grouping import connected_groups, group_records, record_links

ENTITY = "mention_id bigint, book_num int, entity_type string, name string, aliases array<string>, salt string, key string"
MATCH = "match_id bigint, left_id bigint, right_id bigint, decision string, id int"


def closure(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_groups_are_the_closure(spark):
    rng = random.Random(1)
    edges = [(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(90)]
    edges += [(k, k + 1) for k in range(1000, 1150)] + [(5000, 5001 + k) for k in range(200)] + [(7, 7)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    found = {r["id"]: r["group_id"] for r in connected_groups(df, base_arcs=0).collect()}
    assert found == {r["id"]: r["group_id"] for r in connected_groups(df).collect()} == {r["id"]: r["group_id"] for r in connected_groups(df, base_arcs=600).collect()}
    assert found == closure([(a, b) for a, b in edges if a != b])


def test_parameters_do_not_change_the_groups(spark):
    edges = [(k, k + 1) for k in range(6)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    for beta, hops in ((0.5, 1), (0.05, 5), (0.3, 2)):
        assert {r["group_id"] for r in connected_groups(df, beta=beta, hops_at_once=hops, seed=3, base_arcs=0).collect()} == {0}


def test_clusters_grow_as_far_as_their_start_times_allow(spark):
    from fablespark.llm import grouping

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    shift = {r["id"]: r["s"] for r in spark.range(41).select("id", grouping._shift(F.col("id"), 5, 0.1).alias("s")).collect()}
    centre = {r["id"]: r["centre"] for r in grouping._decompose(grouping._arcs(edges), 5, 0.1, 3).collect()}
    assert centre == {v: max(range(41), key=lambda c: shift[c] - abs(c - v)) for v in range(41)}


def test_empty_and_null(spark):
    assert connected_groups(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    none = spark.createDataFrame([], ENTITY)
    assert group_records(none, spark.createDataFrame([], MATCH)).count() == 0


def test_links(spark):
    rows = [
        (1, 1, "c", "The  Fox ", ["A"], "s", "k"),
        (2, 1, "c", "the fox", None, None, None),
        (2, 1, "c", "the fox", None, None, None),  # a repeated row
        (3, 1, "c", None, ["a", " ", None], None, None),
        (4, 2, "c", "the fox", [], None, None),
        (5, 1, "l", "the fox", [], None, None),
        (6, None, "c", "the fox", [], None, None),
        (None, 1, "c", "the fox", [], None, None),
        (7, 1, "c", " ", [""], None, None),
        (8, 1, "c", "", [" "], None, None),
    ]
    matches = [(1, 5, 4, "same", 1), (2, 5, 4, "different", 1), (3, 7, 7, "same", 1), (4, 7, 99, "same", 1), (5, None, 8, "same", 1), (6, 8, 7, "unsure", 1), (7, 8, 7, None, 1)]
    found = group_records(spark.createDataFrame(rows, ENTITY), spark.createDataFrame(matches, MATCH))
    assert {(r["mention_id"], r["group_id"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_a_hot_string_gives_few_links(spark):
    rows = [(k, 1, "c", "same", [], None, None) for k in range(2000)]
    links = record_links(spark.createDataFrame(rows, ENTITY), spark.createDataFrame([], MATCH))
    assert links.count() == 1999
    parted = record_links(spark.createDataFrame(rows, ENTITY), spark.createDataFrame([], MATCH), rows_per_hub=100)
    assert parted.count() == 1999 and max(r["count"] for r in parted.groupBy("u").count().collect()) < 300
    assert {r["group_id"] for r in connected_groups(parted).collect()} == {0}
    assert {r["group_id"] for r in connected_groups(links).collect()} == {0}
