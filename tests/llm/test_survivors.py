import datetime as dt
import random

import numpy as np

from fablespark.llm import survivors as sv

ENTITY = "mention_id bigint, book_num int, entity_type string, name string, description string, aliases array<string>, source_chapters array<int>, extractor_id int, extracted_at timestamp, trust string, has string"
EXTRACTORS = "extractor_id int, trust int"


def random_rows(rng, n, groups):
    start = dt.datetime(2025, 1, 1)
    return [
        (k, rng.randint(1, 2), "c", rng.choice([f"Name {rng.randint(1, groups)}", f"name  {rng.randint(1, groups)}"]), rng.choice([None, "", "d" * rng.randint(1, 9)]), rng.choice([None, [], ["a", "a", None, " "], ["a", "b"]]), rng.choice([None, [1, 1], [1, 2], [3]]), rng.choice([None, 1, 2, 9]), rng.choice([None, start + dt.timedelta(hours=rng.randint(0, 5))]), "t", "h")
        for k in range(1, n + 1)
    ]


def vector(row, trust):
    return (len(row[4] or ""), len({a for a in row[5] or [] if a and a.strip()}), len(set(row[6] or [])), row[8].timestamp() if row[8] else -1e18, trust.get(row[7], 0))


def brute(rows, trust):
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2], " ".join(r[3].lower().split())), []).append(r)
    found = set()
    for g in groups.values():
        top = [r for r in g if all(all(x >= y for x, y in zip(vector(r, trust), vector(o, trust))) for o in g)]
        if len(g) > 1 and len(top) == 1:
            found.add(top[0][0])
    return found, groups


def test_skyline():
    rng = np.random.default_rng(1)
    for _ in range(30):
        points = rng.integers(0, 4, (rng.integers(1, 40), 5))
        dominated = [any((q >= p).all() and (q > p).any() for q in points) for p in points]
        assert list(sv.skyline(points)) == [not d for d in dominated]


def test_dominant_records(spark):
    trust = {1: 1, 2: 5}
    for seed in range(3):
        rows = random_rows(random.Random(seed), 120, 20 + 10 * seed)
        df = spark.createDataFrame(rows + rows[:10], ENTITY).repartition(5)
        picks = sv.choose(df, spark.createDataFrame(list(trust.items()), EXTRACTORS)).collect()
        expected, groups = brute(rows, trust)
        assert {p["base_id"] for p in picks if p["dominant"]} == expected
        assert len(picks) == sum(len(g) > 1 for g in groups.values())


def test_partitions_do_not_matter(spark):
    rows = random_rows(random.Random(9), 300, 3)
    extractors = spark.createDataFrame([(1, 1), (2, 5)], EXTRACTORS)
    results = [sorted(map(str, sv.choose(spark.createDataFrame(rows, ENTITY).repartition(n), extractors).collect())) for n in (1, 7)]
    assert results[0] == results[1]


def test_nulls_are_filled_from_later_layers(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [
        (1, 1, "c", "A", None, None, [1, 2], 2, t, "", ""),
        (2, 1, "c", "a ", "long text", ["x"], None, 1, t - dt.timedelta(1), "", ""),
        (3, 1, "c", "A", "text", None, None, None, None, "", ""),
        (4, 1, "c", "solo", None, None, None, None, None, "", ""),
        (5, 1, "c", None, None, None, None, None, None, "", ""),
    ]
    out = sv.survivors(spark.createDataFrame(rows, ENTITY), spark.createDataFrame([(1, 1), (2, 5)], EXTRACTORS)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["mention_id"], r["name"], r["description"], r["aliases"], r["source_chapters"], r["extractor_id"], r["dominant"]) == (1, "A", "long text", ["x"], [1, 2], 2, False)


def layers_of(points):
    layer, left = {}, set(range(len(points)))
    while left:
        top = {i for i in left if not any(all(x >= y for x, y in zip(points[j], points[i])) and points[j] != points[i] for j in left)}
        depth = max(layer.values(), default=0) + 1
        layer |= dict.fromkeys(top, depth)
        left -= top
    return layer


def test_fields_come_from_the_first_layer_that_has_them(spark):
    trust = {1: 0, 2: 1, 3: 0}
    start = dt.datetime(2025, 1, 1)
    rng = random.Random(3)
    rows = [
        (k, 1, "c", f"N{rng.randint(1, 70)}", rng.choice([None, " ", "    ", "d", "dd"]), rng.choice([None, ["a"]]), rng.choice([None, [1]]), rng.choice([None, None, 1, 3, 9]), start + dt.timedelta(hours=rng.randint(0, 6)), "t", "h")
        for k in range(1, 600)
    ]
    picks = {p["clean_name"]: p for p in sv.choose_all(spark.createDataFrame(rows, ENTITY).repartition(3), spark.createDataFrame(list(trust.items()), EXTRACTORS)).collect()}
    groups, deep = {}, 0
    for r in rows:
        groups.setdefault(r[3].lower(), []).append(r)
    assert {n for n, g in groups.items() if len(g) > 1} == picks.keys()
    there = {"description": lambda r: (r[4] or "").strip() != "", "aliases": lambda r: bool(r[5]), "source_chapters": lambda r: bool(r[6]), "extractor_id": lambda r: r[7] is not None}
    for name, p in picks.items():
        g = groups[name]
        points = [vector(r, trust) for r in g]
        layer = layers_of(points)
        order = sorted(range(len(g)), key=lambda i: (layer[i], -points[i][4], -points[i][3], -points[i][0], -points[i][1], -points[i][2], g[i][0]))
        assert p["base_id"] == g[order[0]][0]
        for field, has in there.items():
            source = next((i for i in order if has(g[i])), None)
            deep += source is not None and layer[source] > 1
            assert p[f"{field}_from"] == (None if source is None else g[source][0]), (name, field)
    assert deep > 10


def test_ties_and_empty(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(k, 1, "c", "A", "d", ["x"], [1], 1, t, "", "") for k in (2, 1)]
    extractors = spark.createDataFrame([(1, 1)], EXTRACTORS)
    p = sv.choose(spark.createDataFrame(rows, ENTITY), extractors).collect()
    assert [(x["base_id"], x["dominant"]) for x in p] == [(1, False)]
    assert sv.choose(spark.createDataFrame([], ENTITY), extractors).count() == 0
    assert sv.survivors(spark.createDataFrame([], ENTITY), spark.createDataFrame([], EXTRACTORS)).count() == 0
