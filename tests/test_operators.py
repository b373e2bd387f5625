import random

import numpy as np
from pyspark.sql import functions as F

from fablespark.operators import chapters as ch
from fablespark.operators import chunking as ck
from fablespark.operators import entities as en
from fablespark.operators import extraction as ex
from fablespark.operators import mentions as mn
from fablespark.operators import retrieval as rt
from fablespark.operators import scenes as sc
from fablespark.params import ChapterFilter, ChunkProfile, DedupParams, Params, SceneProfile, describe


def sims(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate([*values, None])], "c int, k int, sim double")


FIXED = SceneProfile(strategy="fixed")


def test_golden_scene_boundaries(spark):
    cases = {(0.92, 0.85, 0.88, 0.90): [2], (0.92, 0.85, 0.91, 0.90): [], (0.95, 0.86, 0.80, 0.83): [2, 3], (0.90, 0.80): [], (0.99, 0.95, 0.96, 0.97): []}
    for values, expected in cases.items():
        marked = sc.mark_boundaries(sims(spark, values), ["c"], "k", FIXED)
        assert [r["k"] + 1 for r in marked.where("valley").orderBy("k").collect()] == expected


def test_golden_scenes(spark):
    marked = sc.mark_boundaries(sims(spark, (0.92, 0.85, 0.88, 0.90)), ["c"], "k", FIXED)
    scenes = sc.build_scenes(sc.number_scenes(marked, ["c"], "k"), ["c"], "k", FIXED, chunk="k").orderBy("scene_number").collect()
    assert [(s["chunk_ids"], round(s["avg_similarity"], 9), s["min_similarity"]) for s in scenes] == [([0, 1], 0.92, 0.92), ([2, 3, 4], 0.89, 0.88)]


def test_short_chapters_have_no_scenes_unless_wanted(spark):
    marked = sc.mark_boundaries(sims(spark, ()), ["c"], "k", FIXED)
    numbered = sc.number_scenes(marked, ["c"], "k")
    assert sc.build_scenes(numbered, ["c"], "k", FIXED).count() == 0
    assert sc.build_scenes(numbered, ["c"], "k", SceneProfile(drop_short=False)).count() == 1


def test_scene_plan_has_one_exchange(spark):
    chunks = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(9)], "c int, k int, embedding array<double>")
    plan = sc.number_scenes(sc.mark_boundaries(sc.consecutive_similarity(chunks, ["c"], "k"), ["c"], "k"), ["c"], "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tiny_merge(spark):
    rows = spark.createDataFrame([(1, k, n, f"t{k}") for k, n in enumerate((10, 60, 5, 5, 70, 49))], "c int, k int, n int, t string")
    merged = ck.merge_tiny(rows, ["c"], "k", "n", "t", 50).orderBy("group").collect()
    assert [(m["chunks"], m["tokens"], m["text"]) for m in merged] == [(1, 10, "t0"), (3, 70, "t1 t2 t3"), (2, 119, "t4 t5")]


def pack(sizes, limit, separator=0):
    groups, used = [], 0
    for n in sizes:
        if groups and used + separator + n <= limit:
            groups[-1].append(n)
            used += separator + n
        else:
            groups.append([n])
            used = n
    return groups


def test_packing_fold_is_the_loop(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randint(1, 14) for _ in range(rng.randint(0, 20))]) for k in range(60)] + [(99, [4, 6, 1, 12, 3])]
    for separator in (0, 2):
        df = spark.createDataFrame(rows, "k int, n array<int>").select("k", "n", ck.pack_groups(F.col("n"), 10, separator).alias("g"))
        for r in df.collect():
            groups = [[n for n, g in zip(r["n"], r["g"]) if g == k] for k in dict.fromkeys(r["g"])]
            assert groups == pack(r["n"], 10, separator)
    assert pack([4, 6, 1, 12, 3], 10) == [[4, 6], [1], [12], [3]]


def test_split_long(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).head()["x"]
    assert one("Aa. Bb. Cc.", ck.split_long(F.col("t"), 7)) == ["Aa. Bb.", "Cc."]
    assert one("abcdefghij. Bb.", ck.split_long(F.col("t"), 4)) == ["abcd", "efgh", "ij.", "Bb."]
    assert one(" ab ", ck.split_or_keep(F.col("t"), 7)) == ["ab"]
    assert one("  ", ck.split_or_keep(F.col("t"), 7)) == []
    assert one("aaa\n\nbbb\n \nccc", ck.split_or_keep(F.col("t"), 8)) == ["aaa\n\nbbb", "ccc"]


def test_overlapping_windows_cover_the_text():
    text = " ".join(f"Sentence number {k} ends here." for k in range(60))
    windows = ck.overlapping_windows(text, 200, 320, 40)
    assert all(len(w) <= 320 for w in windows) and windows[-1].endswith("59 ends here.")
    at = 0
    for w in windows:
        found = text.find(w, max(0, at - 60))
        assert found >= 0 and found <= at
        at = found + len(w) + 1


def test_semantic_chunks():
    p = ChunkProfile(max_tokens=6, min_tokens=2, similarity_threshold=0.5)
    same = lambda texts: np.array([[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts])
    assert ck.semantic_chunks("A a. A a. B b. B b.".lower(), p, same) == ["a a. a a.", "b b. b b."]
    fails = lambda texts: 1 / 0
    assert ck.semantic_chunks("a a. a a. b b. b b.", p, fails) == ["a a. a a. b b.", "b b."]
    assert ck.semantic_chunks("", p) == [] and ck.semantic_chunks("x", ChunkProfile(base_unit="line")) == []
    overlapped = ck.semantic_chunks("a1 x. a2 x. a3 x. a4 x.", ChunkProfile(max_tokens=4, min_tokens=9, overlap_tokens=2, similarity_threshold=0), same)
    assert overlapped == ["a1 x. a2 x.", "a2 x. a3 x.", "a3 x. a4 x."]
    assert all(len(c.split()) <= 3 for c in ck.semantic_chunks("one two three four five six seven", ChunkProfile(max_tokens=3)))


def test_chapters(spark):
    pages = spark.createDataFrame([(1, 1, ["1", "Title", "aaaa", "bb", "c"]), (1, 2, ["x"]), (1, 3, ["3", "Next", "dd", "ee", "ff"]), (2, 1, None)], "book_num int, position int, paragraphs array<string>")
    rows = ch.build_chapters(pages, ChapterFilter(min_chars=5, min_paragraphs=3)).orderBy("chapter_num").collect()
    assert [(r["chapter_num"], r["chapter_title"], r["paragraph_count"], r["paragraph_min_chars"], r["paragraph_max_chars"], r["paragraph_avg_chars"]) for r in rows] == [(1, "Title", 3, 1, 4, 2), (2, "Next", 3, 2, 2, 2)]
    parity = ch.build_chapters(pages, ChapterFilter(min_chars=5, min_paragraphs=3), parity=True).orderBy("chapter_num").collect()
    assert parity[0]["paragraph_max_chars"] == 1


def test_latest_keeps_the_last_delivery(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", None)], "k int, v string, ingested_at int")
    assert {(r["k"], r["v"]) for r in ch.latest(df, ["k"]).collect()} == {(1, "b"), (2, "d")}


def test_merge(spark):
    rows = spark.createDataFrame([(1, "k", "Ab", ["x"], "king", [2]), (2, "k", "Abc", ["Ab", "y"], "lord", [1, 2]), (3, "l", "Solo", None, None, None)], "o int, k string, name string, aliases array<string>, role string, source_chapters array<int>")
    merged = {r["k"]: r for r in en.merge_groups(rows, ["k"], "o", ["role"]).collect()}
    r = merged["k"]
    assert (r["name"], r["aliases"], r["role"], r["source_chapters"]) == ("Abc", ["Ab", "x", "y"], "lord", [1, 2])
    assert merged["l"]["aliases"] == [] and merged["l"]["source_chapters"] == []


def test_raw_merge_keeps_what_is_not_alike(spark):
    rows = spark.createDataFrame([("c", "A", "a tall man", ["x"], 1), ("c", "A", "A tall man.", ["X", "quite other"], 2), ("c", "A", None, None, 3)], "entity_type string, name string, description string, aliases array<string>, o int")
    r = en.merge_raw(rows, ["entity_type", "name"], "o").head()
    assert (r["description"], r["aliases"]) == (["a tall man"], ["x", "quite other"])


def test_alias_merge(spark):
    df = spark.createDataFrame([(["Fox", "fox ", "Owl"], ["FOX", "Elk", " ", None]), (None, None)], "a array<string>, b array<string>")
    assert [r["m"] for r in df.select(en.merge_aliases(F.col("a"), F.col("b")).alias("m")).collect()] == [["Elk", "Owl", "fox "], []]


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)]
    edges = [(f"{a:03}", f"{b:03}") for a, b in edges if a != b]
    found = {r["id"]: r["component"] for r in en.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert found == union_find(edges)
    assert en.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_resolution_finds_every_pair_of_sufficient_ratio(spark):
    from fablespark.functions.similarity import ratio

    rng = random.Random(4)
    names = set()
    for _ in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 16))).strip() or "a"
        for _ in range(3):
            n = list(base)
            for _ in range(rng.randint(0, 2)):
                n[rng.randrange(len(n))] = rng.choice("abcdefgh")
            names.add("".join(n).strip() or "b")
    rows = [(str(k), 1, n, []) for k, n in enumerate(sorted(names))]
    p = DedupParams()
    needed = lambda a, b: 95 if min(len(a), len(b)) <= 5 else 90 if min(len(a), len(b)) <= 10 else 85
    expected = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and ratio(a[2], b[2]) >= needed(a[2], b[2])}
    found = {(r["u"], r["v"]) for r in en.resolution_edges(spark.createDataFrame(rows, "id string, g int, name string, aliases array<string>"), ["g"], p).collect()}
    assert found == expected and expected


def test_resolution_by_alias(spark):
    rows = [("1", 1, "bard", ["the bowman"], [1], 1), ("2", 1, "girion", ["The Bowman "], [2], 2), ("3", 1, "smaug", None, None, 3), ("4", 2, "bard", [], [1], 4)]
    merged = en.resolve_entities(spark.createDataFrame(rows, "id string, g int, name string, aliases array<string>, source_chapters array<int>, order int"), ["g"], strings=[])
    assert sorted((r["g"], r["name"], r["source_chapters"]) for r in merged.collect()) == [(1, "girion", [1, 2]), (1, "smaug", []), (2, "bard", [1])]


def test_validation(spark):
    rows = spark.createDataFrame([("character", "A", "d"), (None, " ", ""), ("ghost", "B", "d")], "entity_type string, name string, description string")
    assert [r["errors"] for r in en.validation_errors(rows, ["description"]).collect()] == [[], ["no entity_type", "no name", "no descriptive field"], ["unknown type ghost"]]


def test_mentions_against_brute_force(spark):
    texts = spark.createDataFrame([(1, "The Old Took met Al-Ba. String?"), (1, "cold tooks"), (2, "the ring"), (2, None)], "b int, text string").withColumn("k", F.monotonically_increasing_id())
    entities = spark.createDataFrame([(1, "Old Took", ["ring", None]), (1, "al-ba", None), (2, "Ring", [""])], "b int, name string, aliases array<string>")
    hits = mn.entities_in_texts(texts.where("text IS NOT NULL"), ["k"], entities, ["b", "name"], ["b"]).join(texts, ["b", "k"])
    assert sorted((r["text"][:4], r["name"]) for r in hits.collect()) == [("The ", "Old Took"), ("The ", "al-ba"), ("cold", "Old Took"), ("the ", "Ring")]


def test_seen_before_and_context(spark):
    e = spark.createDataFrame([(1, 1, "character", "A", ["x"]), (1, 2, "character", "A", ["y"]), (1, 3, "location", "P", None)], "book_num int, chapter_num int, entity_type string, name string, aliases array<string>")
    before = mn.seen_before(e, e)
    assert sorted((r["chapter_num"], r["name"], r["aliases"]) for r in before.collect()) == [(2, "A", ["x"]), (3, "A", ["x", "y"])]
    assert {r["chapter_num"]: r["context"] for r in mn.context_sections(before, ["book_num", "chapter_num"]).collect()} == {2: "- A (x)", 3: "- A (x, y)"}


def test_model_calls_retry_and_report(spark):
    def factory():
        calls = {}

        def model(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "late" and calls[prompt] < 3):
                raise OSError("down")
            return prompt.upper()

        return model

    rows = ex.call_model(spark.createDataFrame([("ok",), ("late",), ("bad",), (None,)], "prompt string").coalesce(1), factory).collect()
    assert [(r["response"], r["error"]) for r in rows] == [("OK", None), ("LATE", None), (None, "OSError: down"), (None, None)]


def test_extraction_and_structuring(spark):
    from fablespark.backends.models import create

    chunks = spark.createDataFrame([(1, "Ana Bell met Tom Reed in Whitford. Ana Bell left."), (2, "nothing here")], "chapter_num int, text string")
    raw = ex.extract_raw(chunks, lambda: create("rules"), ["chapter_num"])
    assert {(r["entity_type"], r["name"]) for r in raw.collect()} == {("character", "Ana Bell"), ("character", "Tom Reed"), ("location", "Whitford")}
    for model, error in ((create("rule structure"), None), (lambda prompt: "no JSON", "unreadable")):
        rows = ex.structure_entities(raw, lambda model=model: model, ["chapter_num"]).collect()
        assert sorted((r["types"], r["name"]) for r in rows) == [("character+group", "Ana Bell"), ("character+group", "Tom Reed"), ("location", "Whitford")]
        assert {r["error"] for r in rows} == {error} and all(r["description"] for r in rows)
    assert ex.legacy_prompts(chunks, ["chapter_num"]).count() == 16


def test_retrieval(spark):
    assert {r["node"]: r["steps"] for r in rt.shortest_paths(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (9, 8)], "src int, dst int"), spark.createDataFrame([(1,)], "node int")).collect()} == {1: 0, 2: 1, 3: 1}
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, k int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99), (3, 5)], "query_id int, k int")
    metrics = {r["query_id"]: r for r in rt.retrieval_metrics(ranking, relevant, "k", 2).collect()}
    assert (metrics[1]["recall"], metrics[1]["precision"], metrics[1]["reciprocal_rank"]) == (0.5, 0.5, 0.5) and metrics[3]["recall"] == 0
    candidates = spark.createDataFrame([(1, 5, "a", "a b"), (1, 6, "a", "c")], "query_id int, k int, query string, text string")
    best = rt.rerank(candidates, lambda: (lambda q, t: float(q in t.split())), "k", 1).collect()
    assert [r["k"] for r in best] == [5]
    layers = rt.layered_top_k({"chunk": (ranking, "k", 1), "scene": (ranking, "k", 2)})
    assert layers.count() == 5
    kinds = spark.createDataFrame([("Why did he go?",), ("When did it end?",), ("Who is Ana?",)], "q string").select(rt.route_query(F.col("q")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["causal", "temporal", "factual"]


def test_parameters_are_shown():
    assert "min_chars: 1000" in describe(Params())


def test_profiles(spark):
    import pytest

    from fablespark.operators import profiles as pf

    df = spark.createDataFrame([(1, "a")], "k int, t string")
    assert pf.require_fields(df, ["k"]) is df
    with pytest.raises(ValueError):
        pf.require_fields(df, ["x"])
    assert pf.chapter_summaries(df, ["k"], lambda: len, "t").columns == ["k", "summary", "error"]
    p = spark.createDataFrame([(1, 0, "la\nli\nlo"), (1, 1, "prose " * 30)], "k int, position int, paragraph string")
    assert [r["position"] for r in pf.without_songs(p, ["k"]).collect()] == [1]


def test_mentions_of_terms_of_all_forms(spark):
    """Every form of term is found as the predicate finds it in all pairs of text and term."""
    import itertools
    import random

    from fablespark.functions import text as tx

    rng = random.Random(4)
    parts = ["ana", "bo", "x", "o'brien", "re-ed", "of", "...", "тан", "é", "b_2"]
    terms = sorted({" ".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(60)} | {"a  b", "(x)", "x y"})
    texts = ["".join(rng.choice([*parts, "zz"]) + rng.choice([" ", " ", " ", "\n", ", ", "", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["", "a  b", "Ax yZ", None]
    t = spark.createDataFrame([(k, 1 + k % 2, x) for k, x in enumerate(texts)], "id int, book int, text string")
    e = spark.createDataFrame([(b, x) for b in (1, 2) for x in terms], "book int, term string")
    wanted = {tuple(r) for r in t.crossJoin(e.withColumnRenamed("book", "b")).where(F.col("book") == F.col("b")).where(tx.mentions(F.col("text"), F.col("term"))).select("id", "book", "term").collect()}
    assert len(wanted) > 100
    found = mn.mentioned_terms(t, ["id"], e, ["book"])
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    plan = mn.mentioned_terms(t, ["id"], e, ["book"])._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "(book" in line and "key" not in line and "id" not in line]
    assert list(itertools.islice(found.columns, 3)) == ["id", "book", "term"]


def test_known_counts(spark):
    rows = [(1, c, "t", n) for c, n in ((1, "a"), (1, "b"), (2, "a"), (2, "c"), (4, "d"))] + [(2, 1, "t", "a")]
    found = mn.known_counts(spark.createDataFrame(rows, "book_num int, chapter_num int, entity_type string, name string"))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2), (1, 4, 3)}


def test_records_and_schemas_are_united(spark):
    from fablespark.runtime import union_all

    kind = "k int, o int, name string, aliases array<string>, source_chapters array<int>, traits array<struct<t:string,n:int>>"
    rows = [(1, 1, "Ana", ["A"], [2], [("kind", 1), ("old", 2)]), (1, 2, "Ana Bell", None, [1], [("kind", 1), None]), (1, 3, "An", [], None, None)]
    merged = en.merge_groups(spark.createDataFrame(rows, kind), ["k"], "o", records=["traits"]).collect()
    assert [(r["name"], r["aliases"], r["source_chapters"], [tuple(t) for t in r["traits"]]) for r in merged] == [("Ana Bell", ["A", "An", "Ana"], [1, 2], [("kind", 1), ("old", 2)])]
    both = union_all([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 0.5)], "a int, c double")], missing=True)
    assert {tuple(r) for r in both.select("a", "b", "c").collect()} == {(1, "x", None), (2, None, 0.5)}


def test_new_aliases_are_merged_back(spark):
    people = spark.createDataFrame([(1, "Ana", ["Annie"]), (1, "Tom", None)], "book_num int, name string, aliases array<string>")
    found = spark.createDataFrame([(1, "Ana", ["annie", "A."])], "book_num int, name string, new_aliases array<string>")
    assert {r["name"]: r["aliases"] for r in ex.with_new_aliases(people, found, ["book_num"]).collect()} == {"Ana": ["A.", "Annie"], "Tom": None}


def test_small_reports(spark):
    rows = [(1, 1, 1, "character", "Ana", [1], ["x"]), (2, 1, 1, "character", "ana ", [1], []), (3, 1, 3, "location", "Elm", [3], []), (4, 1, 2, "character", "Ana", [2], [])]
    e = spark.createDataFrame(rows, "mention_id bigint, book_num int, chapter_num int, entity_type string, name string, source_chapters array<int>, aliases array<string>")
    report = {(r["entity_type"], r["is_total"]): r.asDict() for r in en.dedup_report(e, e.where("mention_id <> 2"), e.where("mention_id IN (1, 3)")).collect()}
    assert report.keys() == {("character", 0), ("location", 0), (None, 1)} and (report[None, 1]["raw"], report[None, 1]["final"], report[None, 1]["reduction_pct"]) == (4, 2, 50.0)
    assert {r["mention_id"] for r in en.entities_where(e, "ANA", 1).collect()} == {1, 2} and en.entities_where(e).count() == 4
    assert en.by_type(e.where("mention_id <> 2"), ["book_num"]).collect()[0]["entities"] == {"character": ["Ana"], "location": ["Elm"]}
    late = e.withColumn("mention_id", -F.col("mention_id"))
    assert {r["name"]: r["chapters"] for r in mn.first_seen_index(late, ["name"]).collect()} == {"Ana": [2, 1], "ana ": [1], "Elm": [3]}
    scenes = spark.createDataFrame([(1, 2, 30, 2), (1, 1, 10, 3), (1, 3, 5, 1)], "chapter int, scene_number int, tokens int, num_chunks int")
    r = sc.scene_lists(scenes, ["chapter"]).collect()[0]
    assert (r["scenes"], r["scene_tokens"], r["boundaries"], r["avg_tokens"]) == (3, [10, 30, 5], [3, 5], 15.0)


def test_backends_by_name_and_cache():
    from fablespark.backends import models

    asked = []
    model = models.Cached(lambda prompt: asked.append(prompt) or prompt.upper())
    assert [model("a"), model("a"), model("b")] == ["A", "A", "B"] and asked == ["a", "b"]
    assert models.create("http embedding", url="http://127.0.0.1:9/", model="m").check(timeout=0.2) is False
