import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fablespark.llm import splitting as sp


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.data())
@settings(max_examples=80, deadline=None)
def test_range_maximum(values, data):
    table = sp.RangeMaximum(np.array(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    best = max(values[a : b + 1])
    assert table.rightmost(a, b) == max(k for k in range(a, b + 1) if values[k] == best)


@given(st.text("ab .\n。一ก", max_size=200), st.integers(1, 20), st.integers(0, 25))
@settings(max_examples=150, deadline=None)
def test_pieces(text, limit, overlap):
    spans = [m.span() for m in re.finditer(sp.TOKEN, text)]
    pieces = sp.split_text(text, limit, overlap)
    assert sp.token_counts([text, "", text])[0] == len(spans)
    if len(spans) <= limit:
        assert len(pieces) == 1
        return
    shared = min(overlap, limit - 1)
    assert all(n <= limit for _, _, n in pieces)
    assert pieces[0][0] == spans[0][0] and pieces[-1][1] == spans[-1][1]
    index = {a: k for k, (a, _) in enumerate(spans)}
    ends = {b: k for k, (_, b) in enumerate(spans)}
    for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert ends[b] + 1 - index[c] == shared


def test_cuts_are_at_the_strongest_boundary():
    text = "a b c. d e f\n\ng h. i j k"
    pieces = sp.split_text(text, 8, 0)
    assert text[pieces[0][0] : pieces[0][1]] == "a b c. d e f"
    text = "a b cats. Dogs e f g"
    assert [text[a:b] for a, b, _ in sp.split_text(text, 5, 1)] == ["a b cats.", "cats. Dogs e f g"]


def test_counts_of_scripts():
    assert list(sp.token_counts(["a b c", "日本語", "กขa b", "", "　 \n"])) == [3, 3, 4, 0, 0]


def test_operator(spark):
    chunk = "chunk_id string, text string, profile_id int, max_tokens int, n int"
    long = " ".join("abcdefgh")
    rows = [("a", long, 1, 9, 0), ("a", long, 1, 9, 1), ("b", "x y", 1, 0, 0), ("c", None, 1, 0, 0), ("d", "", 1, 0, 0), (None, long, 1, 0, 0), ("e", long, None, 0, 0), ("f", long, 9, 0, 0), ("g", long, 2, 0, 0), ("h", "aaaa", 3, 0, 0), ("i", "一二", 4, 0, 0)]
    profiles = spark.createDataFrame([(1, "p", 4, 1), (2, "q", None, None), (3, "r", 1, None), (4, "s", 0, 5)], "profile_id int, profile_name string, max_tokens int, overlap_tokens int")
    pieces = sp.split_oversized(spark.createDataFrame(rows, chunk), profiles).orderBy("chunk_id", "piece_index").collect()
    assert [(p["chunk_id"], p["piece_index"], p["n_pieces"], p["text"]) for p in pieces if p["chunk_id"] == "a"] == [("a", 1, 3, "a b c d"), ("a", 2, 3, "d e f g"), ("a", 3, 3, "g h")]
    assert {p["chunk_id"] for p in pieces} == {"a", "i"}
    assert all(p["text"] == {"a": long, "i": "一二"}[p["chunk_id"]][p["start_pos"] : p["end_pos"]] for p in pieces)
    assert sp.split_oversized(spark.createDataFrame([], chunk), profiles).count() == 0


def test_a_very_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice(["word", "end.", "x,"]) for _ in range(30_000))
    pieces = sp.split_text(text, 200, 20)
    assert all(n <= 200 for _, _, n in pieces) and pieces[-1][1] == len(text)
