import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fablespark.llm import sentences as se

def sentences_of(text):
    return [text[a:b] for a, b in zip(*se.sentence_spans(text))]


GOLDEN = [
    ["Dr. Pell walked 17.3 ells to Elmgate, i.e. half the way.", "Was it late?", "It was 4 p.m. and dark."],
    ["She sold it to the Rope Co.", "The Rope Co. paid.", "They came at 4 a.m.", "Nobody spoke."],
    ["A. T. Marrable waited... and waited.", "Perhaps he slept...", "Then he woke?!", "Good."],
    ["“Hush. They are coming.” asked the cook in a whisper.", "\"There is room.\"", "Of the three, one stayed.", "She said, \"It is dry again.\"", "He left."],
    ["\"It is true,\" called Ana, \"and he knew it.\"", "‘Stop! Don’t!’ he said.", "Later all went home."],
    ["(No one saw it.)", "The note (cf. vol. 2) was lost.", "Rain fell (p. 203).", "It stopped."],
    ["— We leave at dawn, said Ana.", "—¡Alto! ¿Quién vive? —gritó el vigía.", "La Dra. Vidaurre, p. ej., calló.", "¿Y ahora qué?"],
    ["— Стой! Кто идёт? — спрашивает сторож.", "На ул. Канатной, д. 7, тихо.", "«Мост упал. Идите бродом», — говорит писарь.", "Что теперь?"],
    ["Am 3. Mai kam er.", "Seit dem 14. Jahrhundert, d. h. seit der Flut, stand ein Stein.", "„Halt! Wer da?“, rief der Gerber.", "Bd. 2, S. 14 nennt z. B. das Buch."],
    ["« Arrêtez ! Qui va là ? » cria un garçon.", "Et alors ?", "M. Tissandre (cf. p. 12) parla."],
    ["Ο κ. Θαλασσινίδης, π.χ., έφυγε.", "Και τώρα;", "«Σταθείτε! Ποιος είναι;» φώναξε ο φύλακας."],
    ["قال الحارس: «قفوا! من هناك؟».", "د. مرجان عدّ المفتاح.", "وماذا الآن؟"],
    ["“रुको! कौन है?” मुंशी ने पूछा।", "डॉ. नीलकमल आई।", "अब क्या?"],
    ["von Esk slept.", "von Esk woke."],
]
JOINED = [
    ["「橋は落ちた。行け。」と門番が言った。", "（誰も答えなかった。）", "門まで0.75里あり、待った……そして去った。", "見張り？！", "６時だ。"],
    ["老皮匠说：“桥断了。走吧。”", "“站住！是谁？”铸钟女喊道。", "现在怎么办？", "6:30左右，他走了。"],
]


@pytest.mark.parametrize("parts", GOLDEN)
def test_golden(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in zip(*se.sentence_spans(text))] == parts


@pytest.mark.parametrize("parts", JOINED)
def test_golden_without_spaces(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in zip(*se.sentence_spans(text))] == parts


def test_thai_gaps():
    text = "ไม่มีใครพูด เวลา 6.30 น. คนแจวเรือฝังสมุด แล้วจะทำอย่างไร"
    assert [text[a:b] for a, b in zip(*se.sentence_spans(text))] == ["ไม่มีใครพูด", "เวลา 6.30 น. คนแจวเรือฝังสมุด", "แล้วจะทำอย่างไร"]


def test_paragraphs_and_lines():
    text = "A heading\n\nOne sentence\nover lines. Two \n \ncut off"
    assert [text[a:b] for a, b in zip(*se.sentence_spans(text))] == ["A heading", "One sentence\nover lines.", "Two", "cut off"]
    missing = "They left.Then it rained at archive.example again."
    assert len(se.sentence_spans(missing)[0]) == 2


def test_an_open_quote_ends_with_its_paragraph():
    text = "“He never closed it. Not once.\n\nNext. One."
    assert len(se.sentence_spans(text)[0]) == 3


@given(st.text("aB .!?\n\"“”‘’«»(),—1。「」กน;", max_size=120))
@settings(max_examples=200, deadline=None)
def test_every_visible_character_is_in_one_sentence(text):
    covered = np.zeros(len(text), dtype=int)
    for a, b in zip(*se.sentence_spans(text)):
        covered[a:b] += 1
        assert not text[a].isspace() and not text[b - 1].isspace()
    assert all(n == 1 for c, n in zip(text, covered) if not c.isspace())


def test_blocks_run_like_one_pass():
    rng = np.random.default_rng(2)
    symbols = rng.integers(1, len(se.SYMBOLS), 700)
    state, cuts = 0, []
    for s in symbols:
        cuts.append(bool(se.CUTS[state, s]))
        state = se.NEXT[state, s]
    for block in (1, 7, 64, 1000):
        assert list(se.run_transducer(symbols, block)) == cuts


def test_batches_do_not_mix_texts():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(GOLDEN)) for _ in range(30)] + ["“open. quote", "x"]
    alone = [(k, int(a), int(b)) for k, t in enumerate(texts) for a, b in zip(*se.sentence_spans(t))]
    together = [(int(k), int(a), int(b)) for w, s, e in se.batch_spans(texts, most_chars=300) for k, a, b in zip(w, s, e)]
    assert together == alone


def test_operator(spark):
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 2), ("b", None, 1), ("c", "", 1), ("d", " \n", 1), (None, "X.", 1)]
    out = se.split_sentences(spark.createDataFrame(rows, "chunk_id string, text string, start_pos int")).collect()
    assert sorted((r["chunk_id"], r["start_pos"], r["end_pos"]) for r in out) == [("a", 0, 4), ("a", 5, 9)]
    assert se.split_sentences(spark.createDataFrame([], "chunk_id string, text string")).count() == 0


def test_no_look_back_is_limited():
    speech = "走" * 3000
    assert sentences_of(f"“{speech}。”他说。") == [f"“{speech}。”他说。"]
    assert sentences_of("He came.)))))) Then he left.") == ["He came.))))))", "Then he left."]
    assert sentences_of("The shop closed on Jan. 5. We left.") == ["The shop closed on Jan. 5.", "We left."]
    dotted = "a." * 40
    assert sentences_of(f"See {dotted}b for more. Done.") == [f"See {dotted}b for more.", "Done."]
