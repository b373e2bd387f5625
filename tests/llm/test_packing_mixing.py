import random

import pytest

from fablespark.llm import mixing as mx
from fablespark.llm import packing as pk
from fablespark.llm import tokens as tk

TOKENS = "doc_id bigint, source string, tokens bigint, h int, start int, part int"


def documents(rng, n):
    return [(k, rng.choice("aaabbc"), rng.choice([0, rng.randint(1, 40), rng.randint(1, 40), rng.randint(90, 700)]), 0, 0, 0) for k in range(n)]


@pytest.mark.parametrize("parts", [1, 4])
def test_packing(spark, parts):
    rows = documents(random.Random(parts), 400)
    containers = spark.createDataFrame([(1, "s", 64), (2, "m", 256), (3, "none", None), (4, "zero", 0)], "container_id int, container_name string, capacity_tokens int")
    packed = pk.pack_documents(spark.createDataFrame(rows, TOKENS), containers, items_per_partition=400 // parts)
    got = packed.collect()
    assert {r["container_id"] for r in got} == {1, 2}
    for container, capacity in ((1, 64), (2, 256)):
        own = [r for r in got if r["container_id"] == container]
        room = {}
        for r in own:
            room[r["container_no"]] = room.get(r["container_no"], 0) + r["tokens"]
        assert max(room.values()) <= capacity
        for doc, _, size, *_ in rows:
            pieces = sorted((r["first_token"], r["tokens"]) for r in own if r["doc_id"] == doc)
            assert sum(n for _, n in pieces) == size
            assert len(pieces) == (0 if not size else 1 if size <= capacity else -(-size // capacity))
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(room.values()) / (len(room) * capacity) > 0.93
    report = pk.packing_report(packed, containers).collect()
    assert {r["container_id"]: r["tokens"] for r in report} == {1: sum(r[2] for r in rows), 2: sum(r[2] for r in rows)}


def test_windows_follow_the_targets():
    rng = random.Random(3)
    items = [(k, "ab"[k % 2], rng.randint(5, 30)) for k in range(4000)]
    total = {s: sum(n for _, x, n in items if x == s) for s in "ab"}
    shares = {s: total[s] / sum(total.values()) for s in "ab"}
    out = pk.pack_queue(items, 1000, shares, {"a": 0.0, "b": 0.0})
    taken = {"a": 0, "b": 0}
    for no in range(40):
        for r in out:
            if r[0] == no:
                taken[r[3]] += r[7]
        assert abs(taken["a"] - shares["a"] * sum(taken.values())) < 100


def test_carried_deficits_come_first():
    items = [(k, "ab"[k % 2], 10) for k in range(100)]
    out = pk.pack_queue(items, 50, {"a": 0.5, "b": 0.5}, {"a": 200.0, "b": -200.0})
    assert {r[3] for r in out if r[0] < 4} == {"a"}


def test_turns_go_round_and_targets_are_met_while_they_can_be():
    rng = random.Random(4)
    items = [(k, "a" if k % 10 == 0 else "b", rng.randint(5, 30)) for k in range(4000)]
    out = pk.pack_queue(items, 1000, {"a": 0.5, "b": 0.5}, {})
    of_a = sum(n for _, s, n in items if s == "a")
    taken, total, no = 0, 0, 0
    while taken < of_a - 500:
        taken += sum(r[7] for r in out if r[0] == no and r[3] == "a")
        total += sum(r[7] for r in out if r[0] == no)
        no += 1
        assert abs(taken - total / 2) < 60
    first = [r[3] for r in sorted(out) if r[0] == 0]
    assert "".join(first).count("ab") > 2  # sources take turns within a container
    assert sum(r[7] for r in out) == sum(n for *_, n in items)


def test_mixture_report(spark):
    rows = [(k, "a" if k < 100 else "b", 10, 0, 0, 0) for k in range(1000)]
    containers = spark.createDataFrame([(1, "s", 100)], "container_id int, container_name string, capacity_tokens int")
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), (None, 1.0)], "source string, share double")
    tokens = spark.createDataFrame(rows, TOKENS)
    packed = pk.pack_documents(tokens, containers, targets)
    got = {r["source"]: r.asDict() for r in pk.mixture_report(packed, targets).collect()}
    assert (got["a"]["share"], got["a"]["owed_tokens"]) == (0.1, 4000) and (got["b"]["owed_tokens"], got["c"]["tokens"], got["c"]["owed_tokens"]) == (-6000, 0, 2000)
    assert {r["source"]: r["owed_tokens"] for r in pk.mixture_report(packed).collect()} == {"a": 0, "b": 0}


def test_packing_of_nothing(spark):
    containers = spark.createDataFrame([(1, "s", 64)], "container_id int, container_name string, capacity_tokens int")
    assert pk.pack_documents(spark.createDataFrame([], TOKENS), containers).count() == 0
    assert pk.pack_documents(spark.createDataFrame([(1, "a", 5, 0, 0, 0)], TOKENS), containers.limit(0)).count() == 0


def test_the_schedule_is_within_one_block():
    rng = random.Random(1)
    for _ in range(40):
        weights = {s: rng.randint(1, 30) for s in "abcdef"[: rng.randint(1, 6)]}
        slots, length = mx.period_schedule(weights), sum(weights.values())
        for s, n in weights.items():
            assert slots.count(s) == n
            done = 0
            for t, x in enumerate(slots, 1):
                done += x == s
                assert abs(done - t * n / length) < 1


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("aaaaab"), rng.randint(1, 30), 0, 0, 0) for k in range(1500)] + [(9000 + k, "tiny", 40, 0, 0, 0) for k in range(3)] + [(9999, None, 5, 0, 0, 0), (9998, "a", 0, 0, 0, 0)]
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "tiny", 0.1, 4), ("m", "absent", 0.1, 3), ("n", "b", 1.0, 2), ("o", "absent", 1.0, 2), ("o", None, 0.5, 1), ("m", "b ", None, None)]
    tokens = spark.createDataFrame(rows, TOKENS)
    table = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    mixed = mx.mix_documents(tokens, table, block_tokens=64).collect()
    used = {}
    for r in mixed:
        used[r["mix_name"], r["doc_id"]] = used.get((r["mix_name"], r["doc_id"]), 0) + 1
    most = {(m, s): n for m, s, _, n in targets}
    source = {k: s for k, s, *_ in rows}
    assert all(n <= most[m, source[d]] for (m, d), n in used.items())
    report = {(r["mix_name"], r["source"]): r for r in mx.mix_report(tokens, table, block_tokens=64).collect()}
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("tiny", 1 / 9)):
        assert abs(report["m", s]["actual_share"] - share) < 0.02
    assert report["m", "tiny"]["most_repeats"] == 4 and report["m", "absent"]["tokens"] == 0
    assert report["n", "b"]["actual_share"] == 1 and report["o", "absent"]["actual_share"] == 0
    order = sorted((r for r in mixed if r["mix_name"] == "m"), key=lambda r: (r["slot"], r["start"]))
    done = {}
    for k, r in enumerate(order):
        done[r["source"]] = done.get(r["source"], 0) + r["tokens"]
        if k > 50:
            assert abs(done["a"] - 5 / 9 * sum(done.values())) < 2 * 64


def test_weights_are_exact():
    assert mx.block_weights({"a": 0.3, "b": 0.45, "c": 0.0}) == {"a": 2, "b": 3}
    assert mx.block_weights({"a": 0.99999, "b": 0.00001}) == {"a": 99999, "b": 1}
    tiny = mx.block_weights({"a": 1.0, "b": 1e-9})
    assert tiny["b"] == 1 and sum(tiny.values()) <= mx.LONGEST_PERIOD + 1


def test_a_given_size_and_gaps_filled_to_the_end(spark):
    rng = random.Random(6)
    rows = [(k, "ab"[k % 2], rng.choice([3, 7, 20, 90, 400]), 0, 0, 0) for k in range(600)] + [(9000, "c", 50, 0, 0, 0)]
    tokens = spark.createDataFrame(rows, TOKENS)
    table = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 1), ("m", "c", 0.2, 3)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mx.mix_documents(tokens, table, 64, total_tokens=10_001).collect()
    report = {r["source"]: r for r in mx.mix_report(tokens, table, 64, total_tokens=10_001).collect()}
    assert (report["c"]["tokens"], report["c"]["short_tokens"], report["c"]["most_repeats"]) == (150, 2000 - 150, 3)
    for s, wanted in (("a", 5000), ("b", 3000)):
        used = [(r["repeat"], r["doc_id"]) for r in mixed if r["source"] == s]
        assert len(set(used)) == len(used)
        left = wanted - sum(r["tokens"] for r in mixed if r["source"] == s)
        most = {"a": 2, "b": 1}[s]
        assert 0 <= left and not any(n <= left for k, x, n, *_ in rows if x == s for p in range(1, most + 1) if (p, k) not in set(used))


def test_mixing_of_nothing(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert mx.mix_documents(spark.createDataFrame([], TOKENS), targets).count() == 0
    assert [r["actual_share"] for r in mx.mix_report(spark.createDataFrame([], TOKENS), targets).collect()] == [0.0]
    assert mx.mix_documents(spark.createDataFrame([(1, "a", 5, 0, 0, 0)], TOKENS), targets.limit(0)).count() == 0


def test_document_tokens(spark):
    path = tk.vocabulary_path()
    rows = [(1, "Hello world", "Fan-Forum "), (1, "Hello", "fan_forum"), (2, None, None), (3, "", " "), (None, "x", "a"), (4, "word " * 50_000, "a")]
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in tk.document_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[1] == ("fan_forum", 2) and got[2] == ("unknown", 0) and got[3] == ("unknown", 0) and got[4][1] == tk.count_tokens(rows[5][1], path) >= 50_000
    assert len(got) == 4
