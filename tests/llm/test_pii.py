import random

import numpy as np
import pytest

from fablespark.llm import pii, pii_model, pii_samples, pii_training

TEXT = "Dear friends,\nMy name is Jorah Corrigault. Write to me at jorah_c44@readers.example if it turns up. You can ring me on +44 7700 900156 after six. Passport no. 000-34-2393, as you asked. Please post it to 148 Quince Avenue, Hobbsend Quay XQ2 2HL. Nobody in Kesthollow had seen Vodnen Northgate since the silent orchard. The first printing was ISBN 978-0-00-533203-9. Order no. 5497-626 shipped on 2025-06-16."
SPANS = {("Jorah Corrigault", "person"), ("jorah_c44@readers.example", "email"), ("+44 7700 900156", "phone"), ("000-34-2393", "id_number"), ("148 Quince Avenue, Hobbsend Quay XQ2 2HL", "address")}
FILLER = "Nobody in Kesthollow had seen the old tanner since the silent orchard. "


def found_in(text):
    return {(text[a:b], k) for _, a, b, k in pii.text_spans([text])}


def test_kinds_are_found_and_stories_are_left():
    assert found_in(TEXT) == SPANS


def test_long_texts_are_tagged_whole():
    texts = [FILLER * 200 + TEXT + FILLER * 200, TEXT, FILLER * 200]
    found = list(pii.text_spans(texts))
    assert {(texts[k][a:b], kind) for k, a, b, kind in found if k == 0} == SPANS
    assert {k for k, *_ in found} == {0, 1}


def test_a_text_has_the_same_spans_whatever_stands_beside_it():
    make = pii_samples.Inventor(random.Random(2))
    texts = [make.passage(lambda: FILLER)[0] for _ in range(120)] + [FILLER * 70 + TEXT, "", "x"]
    alone = [pii_model.trained().spans([t])[0] for t in texts]
    assert pii_model.trained().spans(texts) == alone
    assert pii_model.trained().spans(texts[::-1]) == alone[::-1]


@pytest.mark.parametrize("name_words", [2, 14])
def test_spans_at_the_edges_of_windows(name_words):
    """A span is found as a whole wherever it lies in relation to the windows, a long address too."""
    address = "148 Quince Avenue, Hobbsend Quay XQ2 2HL"
    if name_words > 2:
        address = "Flat 12, 148 Quince Marl Tolley Fenn Avenue,\nHobbsend Quay\nXQ2 2HL"
    step = pii_model.WIDTH - pii_model.OVERLAP
    texts = []
    for k in range(0, 420, 15):
        head = (FILLER * 60)[: step - 40 + k].rsplit(" ", 1)[0]
        texts.append(f"{head} Please post it to {address}. {FILLER * 30}")
    for text, spans in zip(texts, pii_model.trained().spans(texts)):
        inside = [s for s in spans if pii_model.KINDS[s[2]] == "address"]
        assert [text[a:b].rstrip(".") for a, b, _ in inside] == [address]


def test_windows_and_rows_hold_every_character_once():
    width, overlap = pii_model.WIDTH, pii_model.OVERLAP
    for n in (0, 1, width - 1, width, width + 1, 2 * width - overlap, 2 * width - overlap + 1, 9 * width + 7, 1_000_003):
        pieces = [p for unit in pii_model._units(5, n) for p in unit]
        assert all(0 < b - a <= width for _, a, b in pieces)
        assert (not n and not pieces) or (pieces[0][1] == 0 and pieces[-1][2] == n)
        assert all(b - c == overlap for (_, _, b), (_, c, _) in zip(pieces, pieces[1:]))
    rng = random.Random(1)
    units = [u for k in range(3000) for u in pii_model._units(k, rng.choice([rng.randint(1, 300), rng.randint(1, 9000)]))]
    batches = pii_model._batches(units)
    assert [u for batch in batches for u in batch] == units
    for batch in batches:
        places, rows = pii_model._rows(batch)
        assert sorted(places) == sorted(p for u in batch for p in u)
        used = {}
        for (_, a, b), (r, at) in places.items():
            used.setdefault(r, []).append((at, at + b - a))
        assert sorted(used) == list(range(rows))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 1 and spans[-1][1] <= width + 1 and all(y + pii_model.GAPS <= x for (_, y), (x, _) in zip(spans, spans[1:]))
        assert sum(y - x for spans in used.values() for x, y in spans) > 0.85 * rows * width


def test_neighbouring_addresses_are_parted():
    text = "a@b.example c+d @ e.example f@g.test"
    parts = pii.single_pieces(text, 0, len(text), "email")
    assert [text[slice(*pii.exact_edges(text, a, b))] for a, b in parts] == ["a@b.example", "c+d @ e.example", "f@g.test"]


def test_splicing_and_spans_of_tags():
    assert pii_model.splice(np.array([1, 2, 0, 0, 3, 4]), np.array([0, 0, 0, 0, 3, 4])) == 3
    assert pii_model.splice(np.array([1, 2, 2, 2]), np.array([1, 2, 2, 2])) == 2
    assert pii_model.tag_spans(np.array([0, 1, 2, 1, 2, 0, 3, 4, 5, 6])) == [(1, 3, 0), (3, 5, 0), (6, 8, 1), (8, 10, 2)]


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(1)
    tagger = object.__new__(pii_model.Tagger)
    tags = pii_model.TAGS
    tagger.transitions, tagger.start = rng.normal(size=(tags, tags)).astype("f4"), rng.normal(size=tags).astype("f4")
    for k in range(2, tags, 2):  # what goes on follows its own kind alone
        tagger.transitions[[j for j in range(tags) if j not in (k - 1, k)], k] = -30
        tagger.transitions[1:, k - 1] = -30  # and what begins follows what is outside
    scores = rng.normal(size=(4, tags, 3)).astype("f4")
    best = tagger.decode(scores.copy())
    for w in range(3):
        value = lambda p: tagger.start[p[0]] + sum(scores[t, p[t], w] for t in range(4)) + sum(tagger.transitions[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,B023
        top = max(value((a, b, c, d)) for a in range(tags) for b in range(tags) for c in range(tags) for d in range(tags))
        assert abs(value(best[:, w]) - top) < 1e-4


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in pii_training.initial(60, 4, rng).items()}
    ids, tags = rng.integers(2, 60, (6, 2)), np.array([[0, 1], [1, 2], [2, 0], [0, 3], [5, 4], [6, 4]])
    _, g = pii_training.gradients(ids, tags, p, leak=0.0)
    for name in ("Ef", "Ub", "bf", "Vb", "vb", "s", "T"):
        for _ in range(4):
            at = tuple(rng.integers(0, k) for k in p[name].shape)
            if name == "T" and p[name][at] < -20:
                continue
            step, keep = 1e-3, p[name][at]
            p[name][at] = keep + step
            up = pii_training.gradients(ids, tags, p, leak=0.0)[0]
            p[name][at] = keep - step
            down = pii_training.gradients(ids, tags, p, leak=0.0)[0]
            p[name][at] = keep
            assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-3)


def test_scores_are_those_of_the_training():
    """The tagger's fast pass and the training's plain one score a text alike."""
    rng = np.random.default_rng(3)
    own = "abcdefgh"
    p = pii_training.initial(pii_model.first_own_symbol() + len(own), 6, rng)
    tagger = pii_model.Tagger(p | {"own": np.array(own)})
    ids = pii_model.symbols("abch gfed cab", tagger.table)[:, None]
    plain = sum(pii_training.lstm_forward(ids.astype(np.int64), p, d)[0] @ p[f"V{d}"] for d in "fb") + p["vb"]
    assert np.allclose(tagger.emissions(ids)[:, :, 0], plain[:, 0], atol=1e-4)


def test_names_and_forms_that_the_training_never_had():
    make = pii_samples.Inventor(random.Random(12), held=True)
    texts, gold = [], set()
    for k in range(600):
        text, spans = make.passage(lambda: FILLER)
        texts.append(text)
        gold |= {(k, a, b, pii_model.KINDS[kind]) for a, b, kind in spans}
    found = set(pii.text_spans(texts))
    assert len(found & gold) / len(gold) >= 0.93
    touched = {(k, kind, x) for k, a, b, kind in found for x in range(a, b)}
    covered = [sum((k, kind, x) in touched for x in range(a, b)) / (b - a) for k, a, b, kind in gold]
    assert sum(c > 0.8 for c in covered) / len(gold) >= 0.95


def test_the_marker_learns_names_and_towns_from_the_sample():
    texts = [f"Dear {g} {f}, I live at 12 Marl {s}, {t} XQ2 {k}HL." for k, (g, f, s, t) in enumerate([("Oda", "Vex", "Lane", "Little Fen"), ("Pim", "Vex", "Road", "Little Fen"), ("Oda", "Bram", "Road", "Little Fen"), ("Pim", "Bram", "Lane", "Orr"), ("Oda", "Bram", "Lane", "Little Fen")])]
    mark = pii_samples.Marker(texts, {"pim bram"}, least=2)
    text = "It was O. Vex who told Bram, Oda Jr. at 9 Hay Road, Little Fen. Not Pim Bram, not Orr."
    assert [(text[a:b], pii_model.KINDS[k]) for a, b, k in mark(text)] == [("O. Vex", "person"), ("Bram, Oda Jr.", "person"), ("9 Hay Road, Little Fen", "address")]


def test_operator_and_placeholders(spark):
    rows = [(1, TEXT, "x"), (1, TEXT, "y"), (1, "Rain. " + TEXT, "z"), (2, None, "x"), (3, "", "x"), (4, "Rain.", "x"), (None, TEXT, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = pii.find_personal_data(docs.where("kind <> 'z'")).collect()
    assert {(TEXT[r["start_pos"] : r["end_pos"]], r["kind"]) for r in got} == SPANS and {r["doc_id"] for r in got} == {1} and len(got) == 5
    redacted = [(r["doc_id"], r["text"]) for r in pii.redact(docs).collect()]
    shown = "Dear friends,\nMy name is <PERSON>. Write to me at <EMAIL> if it turns up. You can ring me on <PHONE> after six. Passport no. <ID_NUMBER>, as you asked. Please post it to <ADDRESS>. Nobody" + TEXT.partition("Nobody")[2]
    assert sorted(redacted, key=str) == sorted([(1, shown), (1, shown), (1, "Rain. " + shown), (2, None), (3, ""), (4, "Rain."), (None, TEXT)], key=str)
    known = spark.createDataFrame([("jorah  CORRIGAULT ",), (None,)], "name string")
    assert "person" not in {r["kind"] for r in pii.find_personal_data(docs, known).collect()}
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
