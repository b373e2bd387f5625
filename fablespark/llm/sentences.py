"""Sentence boundaries across languages and scripts with a compiled finite transducer.

A lexing pass with bounded context turns each text into a short stream of symbols: stops, blank lines, quotes, brackets,
speech dashes and gaps between unspaced clauses. A transducer over these symbols says after which of them a sentence ends. It
is run on fixed blocks of the stream: each block becomes a function from states to states, the functions are composed by a
parallel prefix scan, and with its start state known each block emits its cuts. So a long text is handled like many short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: characters and abbreviations ------------------------------------------------------------------------

STOP_CHARS = ".…!?！？؟。｡।॥"
OPENERS = "“‘„«「『\"(（["
CLOSERS = "”’»」』)）]"
#: Abbreviations that are never the end of a sentence.
TITLES = {"mr", "mrs", "ms", "dr", "prof", "st", "capt", "rev", "gen", "lt", "col", "sgt", "maj", "cmdr", "hon", "messrs", "fr", "hr", "mme", "mlle", "sr", "sra", "srta", "dra", "ud", "uds", "pág", "ej", "ex", "cf", "ca", "bzw", "ph", "ул", "проф", "डॉ", "श्री", "op", "esp", "vs", "viz", "i.e", "e.g", "π.χ", "т.е", "z.b", "d.h"}
#: Abbreviations that are not the end of a sentence before a number.
NUMBERED = {"no", "nos", "nr", "vol", "vols", "pp", "bd", "fig", "figs", "ch", "sec", "art", "núm", "num", "tel", "гл", "рис", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "okt", "nov", "dec", "dez"}
#: Abbreviations that may end a sentence: they do unless a lower-case letter, a digit or a comma follows.
ENDING = {"co", "ltd", "inc", "etc", "usw", "jr", "a.m", "p.m", "al"}
MONTHS = {"januar", "jänner", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jahrhundert", "jahrhunderts"}
#: Lower-case parts of names that may begin a sentence when a capital follows.
PARTICLES = ("von ", "van ", "de ", "du ", "di ", "da ", "ten ", "ter ", "al-", "d'", "d’")
#: Last words of clauses that report speech, for scripts without capitals.
REPORT_ENDS = ("道", "说", "說", "问", "問", "喊", "叫", "答", "कहा", "पूछा", "दोहराया", "बोला", "बोली", "चिल्लाया", "चिल्लाई")
REPORT_STARTS = ("と", "قال", "كرر", "صاح", "سأل", "أجاب", "ردّ", "همس")

# --- Character classes ---------------------------------------------------------------------------------------------------

OTHER, SPACE, NEWLINE, LOWER, UPPER, DIGIT, CASELESS, THAI, STOP, OPEN, CLOSE, DASH, COMMA, APOSTROPHE = range(14)


def _class_table() -> np.ndarray:
    table = np.full(65536, OTHER, dtype=np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.isspace() or c in "\u200b\ufeff":
            table[code] = SPACE
        elif "\u0e00" <= c <= "\u0e7f":
            table[code] = DIGIT if c.isdigit() else THAI
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isupper() or c.istitle():
            table[code] = UPPER
        elif c.islower():
            table[code] = LOWER
        elif c.isalpha() or "\u0900" <= c <= "\u0963":
            table[code] = CASELESS
    for chars, kind in (("\n\u2028\u2029", NEWLINE), (STOP_CHARS, STOP), (OPENERS, OPEN), (CLOSERS, CLOSE), ("—–―-", DASH), (",;:،؛、，；：·", COMMA), ("'", APOSTROPHE)):
        for c in chars:
            table[ord(c)] = kind
    return table


CLASS = _class_table()
_GREEK = np.zeros(65536, dtype=bool)
_GREEK[0x0370:0x0400] = _GREEK[0x1F00:0x2000] = True

# --- The transducer ------------------------------------------------------------------------------------------------------

QUOTES = {"“": "”", "‘": "’", "„": "“", "«": "»", "「": "」", "『": "』", '"': '"'}
STATES = ["plain", "dash", "bracket", "sentence bracket", *(f"quote {q}" for q in QUOTES)]
#: Quote characters come in two symbols: a sentence would end after them if they close one, or it would go on.
SYMBOLS = ["blank", "stop", "stop but in dash speech", "gap", "dash", "open bracket", "open sentence bracket", "close bracket, end", "close bracket, go on", *(f"{c}, {x}" for c in sorted({*QUOTES, *QUOTES.values()}) for x in ("end", "go on"))]
SYMBOL = {s: k for k, s in enumerate(SYMBOLS)}
BLOCK = 64


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cut) tables, indexed by state and symbol."""
    step = {}
    for state in STATES:
        outside = state in ("plain", "dash")
        for symbol in SYMBOLS:
            step[state, symbol] = (state, False)
        step[state, "blank"] = ("plain", True)
        if outside:
            step[state, "stop"] = step[state, "gap"] = ("plain", True)
            step[state, "dash"] = ("dash", False)
            step[state, "open bracket"] = ("bracket", False)
            step[state, "open sentence bracket"] = ("sentence bracket", False)
            for q in QUOTES:
                for x in ("end", "go on"):
                    step[state, f"{q}, {x}"] = (f"quote {q}", False)
        elif "bracket" in state:
            step[state, "close bracket, end"] = ("plain", state == "sentence bracket")
            step[state, "close bracket, go on"] = ("plain", False)
        else:
            close = QUOTES[state[-1]]
            step[state, f"{close}, end"] = ("plain", True)
            step[state, f"{close}, go on"] = ("plain", False)
    step["plain", "stop but in dash speech"] = ("plain", True)
    following = np.array([[STATES.index(step[a, b][0]) for b in SYMBOLS] for a in STATES], dtype=np.int8)
    cuts = np.array([[step[a, b][1] for b in SYMBOLS] for a in STATES])
    return following, cuts


NEXT, CUTS = compile_transducer()


def block_functions(symbols: np.ndarray) -> np.ndarray:
    """State function of each block (row) of symbols: column s holds the state that s ends in."""
    state = np.tile(np.arange(len(STATES), dtype=np.int8), (len(symbols), 1))
    for k in range(symbols.shape[1]):
        state = NEXT[state, symbols[:, k : k + 1]]
    return state


def prefix_compose(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan of state functions by pointer doubling: row i becomes f_i after ... after f_0."""
    done, width = functions.copy(), 1
    while width < len(done):
        done[width:] = np.take_along_axis(done[width:], done[:-width].astype(np.int64), axis=1)
        width *= 2
    return done


def run_transducer(symbols: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Which symbols end a sentence, starting in the plain state."""
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=bool)
    rows = -(-n // block)
    padded = np.full(rows * block, SYMBOL["blank"], dtype=np.int64)
    padded[:n] = symbols
    padded = padded.reshape(rows, block)
    state = np.zeros(rows, dtype=np.int8)
    state[1:] = prefix_compose(block_functions(padded))[:-1, 0]
    cuts = np.empty(padded.shape, dtype=bool)
    for k in range(block):
        cuts[:, k] = CUTS[state, padded[:, k]]
        state = NEXT[state, padded[:, k]]
    return cuts.ravel()[:n]


# --- Lexing ----------------------------------------------------------------------------------------------------------------

_PARTICLE = re.compile(r"(?:" + "|".join(map(re.escape, PARTICLES)) + r")\S")
#: Abbreviations in small letters have fewer letters than this.
_LONGEST_LOWER = 7
_OPENER = {x: o for o, x in QUOTES.items()}
_LETTERS = re.compile(r"\w*")
_SEGMENT = re.compile(r"[^.!?！？؟。।\n]*")


def _particle(text: str, at: int) -> bool:
    m = _PARTICLE.match(text, at)
    return bool(m) and text[m.end() - 1].isupper()


def _dot_ends(text: str, word: str, follow: int, where: int, adjacent: bool) -> bool:
    """Whether a single full stop after ``word`` ends a sentence, when class ``follow`` comes next at position ``where``."""
    low = word.lower()
    if low in ENDING:
        return follow != DIGIT
    if low in TITLES:
        return False
    if low.isdigit():
        after = _LETTERS.match(text, where).group().lower()
        return after not in MONTHS and follow != DIGIT
    if len(word) == 1 and word.isalpha():  # an initial or a one-letter abbreviation
        return False
    if "." in word.strip("."):  # dotted abbreviations and version numbers
        return not adjacent and all(len(part) > 1 for part in word.split("."))
    if follow == DIGIT:
        return low not in NUMBERED and not adjacent
    return True


def lex(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, cut positions, positions of visible characters, their classes) of a text.

    The cut position of a symbol is where the next sentence could begin if one ends with it.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(codes, 65535).astype(np.uint16)
    kind = CLASS[small]
    kind[codes > 65535] = OTHER
    blank = kind <= NEWLINE
    blank &= kind > OTHER
    seen = np.flatnonzero(~blank)
    n = len(seen)
    out_symbols: list[np.ndarray] = []
    out_at: list[np.ndarray] = []
    out_cut: list[np.ndarray] = []
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), seen, kind[seen]
    k, c = kind[seen], small[seen]
    gap = np.diff(seen) > 1  # white space after visible character i
    gap = np.append(gap, True)
    lines = np.cumsum(kind == NEWLINE)
    breaks = np.append(np.diff(lines[seen]), 0)
    after = np.append(k[1:], SPACE)  # class of the next visible character
    after[breaks >= 2] = NEWLINE  # the end of a paragraph
    before = np.insert(k[:-1], 0, NEWLINE)
    before[1:][breaks[:-1] >= 2] = NEWLINE

    def emit(symbol: int | np.ndarray, index: np.ndarray, cut: np.ndarray | None = None, shift: float = 0.0) -> None:
        out_symbols.append(np.full(len(index), symbol) if np.isscalar(symbol) else symbol)
        out_at.append(index + shift)
        out_cut.append(index + 1 if cut is None else cut)

    # Blank lines, after the visible character before them.
    emit(SYMBOL["blank"], np.flatnonzero(breaks >= 2), shift=0.5)

    # Gaps between clauses of a script that writes no stops.
    thai = np.flatnonzero((k == THAI) & gap & np.isin(after, (THAI, LOWER, UPPER, CASELESS, OPEN)))
    emit(SYMBOL["gap"], thai, shift=0.4)

    # Stops: the last of a run.
    greek = np.zeros(n, dtype=bool)
    semicolons = np.flatnonzero((c == ord(";")) | (c == 0x037E))
    semicolons = semicolons[semicolons > 0]
    greek[semicolons] = _GREEK[c[semicolons - 1]]
    stop = (k == STOP) | greek
    adjoining = np.append(stop[1:] & ~gap[:-1], False)
    stops = np.flatnonzero(stop & ~adjoining)
    follow, where, touching = after[stops], np.minimum(stops + 1, n - 1), ~gap[stops]
    closing = touching & (follow == CLOSE)
    while True:  # stray closing marks belong to what they follow
        hit = closing & (k[where] == CLOSE) & (follow != NEWLINE) & (where < n - 1)
        if not hit.any():
            break
        follow = np.where(hit, after[where], follow)
        touching = np.where(hit, ~gap[where], touching)
        where = np.where(hit, np.minimum(where + 1, n - 1), where)
    char = c[stops]
    dot = char == ord(".")
    twice = np.zeros(len(stops), dtype=bool)
    inner = stops > 0
    twice[inner] = stop[stops[inner] - 1] & ~gap[stops[inner] - 1]
    ellipsis = (char == ord("…")) | (dot & twice)
    single = dot & ~ellipsis
    full = (char == ord("。")) | (char == 0xFF61) | (char == ord("।")) | (char == ord("॥"))
    ends = np.ones(len(stops), dtype=bool)
    ends[follow == COMMA] = False
    ends[(follow == LOWER) & ~full] = False
    ends[(follow == DIGIT) & touching & single] = False
    ends[(follow == STOP) & touching] = False
    # A dash before a lower-case letter goes on; one before anything else begins a new sentence.
    second = np.append(after[1:], NEWLINE)
    dashed = follow == DASH
    ends[dashed & (second[np.minimum(stops, n - 1)] == LOWER)] = False
    ends[single & touching & ~np.isin(follow, (UPPER, CASELESS, THAI, NEWLINE, SPACE, OPEN, CLOSE))] = False
    # An ellipsis goes on in the same script without capitals.
    other = np.maximum.accumulate(np.where(stop, 0, np.arange(n)))  # the last visible character that is no stop
    letter = k[other[stops]]
    ends[ellipsis & np.isin(follow, (CASELESS, THAI)) & (follow == letter)] = False
    ends[ellipsis & (follow == DIGIT)] = False
    for i in np.flatnonzero((follow == LOWER) & ~full & ~ellipsis & ~touching):
        if text[seen[where[i]]] in "vdta" and _particle(text, int(seen[where[i]])):
            ends[i] = True
    # A single full stop after something short may be an abbreviation.
    plain = np.ones(len(stops), dtype=bool)
    for d in range(1, _LONGEST_LOWER + 1):
        plain &= k[np.maximum(stops - d, 0)] == LOWER
        plain &= ~gap[np.maximum(stops - d, 0)]
    plain &= stops > _LONGEST_LOWER
    edge = np.isin(k, (OPEN, CLOSE, DASH, COMMA, APOSTROPHE)) | ((k == STOP) & (c != ord(".")))
    begins = np.ones(n, dtype=bool)
    begins[1:] = gap[:-1] | edge[:-1]
    begins |= edge
    word_start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    for i in np.flatnonzero(single & ends & ~plain & (follow != NEWLINE)):
        at = int(seen[stops[i]])
        word = text[int(seen[word_start[stops[i]]]) : at].strip("()[]\"'“”‘’„«»「」『』（）")
        ends[i] = _dot_ends(text, word, int(follow[i]), int(seen[where[i]]), bool(touching[i]))
    last = np.where(closing, where, stops + 1)
    real = np.flatnonzero(ends)
    # In speech after a dash a stop goes on if the next stop is followed by a dash and a lower-case letter.
    reported = dashed & (second[stops] == LOWER)
    comes = np.append(reported[1:], False)
    emit(np.where(comes[real], SYMBOL["stop but in dash speech"], SYMBOL["stop"]), stops[real], last[real])

    stopped = stop.copy()
    fresh = (before == NEWLINE) | np.append(False, stop[:-1] | ((k[:-1] == CLOSE) & np.append(False, stop[:-2])) | (c[:-1] == ord('"')))
    # Dashes that open speech.
    dash = np.flatnonzero((k == DASH) & (c != ord("-")) & fresh & (np.isin(after, (UPPER, CASELESS, THAI)) | np.isin(np.append(c[1:], 0), (ord("¡"), ord("¿")))))
    emit(SYMBOL["dash"], dash)

    # Brackets and quotes.
    ended = np.append(False, stopped[:-1])  # the visible character before is a stop
    goes_on = np.isin(after, (LOWER, COMMA, STOP)) | ((after == DASH) & (second == LOWER))
    opening = np.flatnonzero(np.isin(c, [ord(x) for x in "(（["]))
    starts = fresh[opening] & (after[opening] != LOWER)
    emit(np.where(starts, SYMBOL["open sentence bracket"], SYMBOL["open bracket"]), opening)
    closed = np.flatnonzero(np.isin(c, [ord(x) for x in ")）]"]))
    emit(np.where(ended[closed], SYMBOL["close bracket, end"], SYMBOL["close bracket, go on"]), closed)
    for q in sorted({*QUOTES, *QUOTES.values()}):
        at = np.flatnonzero(c == ord(q))
        if q == "’":  # an apostrophe follows a letter
            at = at[(at > 0) & np.isin(k[np.maximum(at - 1, 0)], (STOP, COMMA, DASH, CLOSE, OTHER))]
        if not len(at):
            continue
        end = ended[at] & ~goes_on[at]
        for i in np.flatnonzero(ended[at] & (after[at] == LOWER)):
            end[i] = _particle(text, int(seen[min(at[i] + 1, n - 1)]))
        caseless = np.flatnonzero(end & np.isin(after[at], (CASELESS,)))
        if len(caseless):
            opens = np.flatnonzero(c == ord(_OPENER.get(q, q)))
            for i in caseless:
                opened = np.searchsorted(opens, at[i]) - 1
                introduced = opened >= 0 and opens[opened] > 0 and chr(c[opens[opened] - 1]) in ":："
                end[i] = not _reported(text, introduced, int(seen[at[i] + 1]))
        cut = at + 1
        while True:
            more = (cut < n) & (k[np.minimum(cut, n - 1)] == CLOSE) & ~gap[cut - 1]
            if not more.any():
                break
            cut = np.where(more, cut + 1, cut)
        emit(np.where(end, SYMBOL[f"{q}, end"], SYMBOL[f"{q}, go on"]), at, cut)

    at = np.concatenate(out_at)
    order = np.argsort(at, kind="stable")
    return np.concatenate(out_symbols).astype(np.int64)[order], np.concatenate(out_cut)[order], seen, k


def _reported(text: str, introduced: bool, following: int) -> bool:
    """Whether the caseless clause after a closing quote reports it; speech that a colon has introduced only if the clause takes it up."""
    if introduced and text[following] != "と":
        return False
    clause = _SEGMENT.match(text, following).group()
    return clause.startswith(REPORT_STARTS) or clause.endswith(REPORT_ENDS)


def sentence_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the sentences of a text, without white space at their ends."""
    symbols, cut, seen, _ = lex(text)
    if not len(seen):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = cut[run_transducer(symbols)]
    first = np.unique(np.concatenate([[0], inside]))
    first = first[first < len(seen)]
    last = np.append(first[1:], len(seen)) - 1
    return seen[first], seen[last] + 1


_JOIN = "\n\n"


def batch_spans(texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, starts, ends) of all sentences; texts are lexed together, a blank line apart."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < most_chars):
            size += len(texts[end]) + len(_JOIN)
            end += 1
        part = texts[begin:end]
        offsets = np.cumsum([0, *(len(t) + len(_JOIN) for t in part)])
        starts, ends = sentence_spans(_JOIN.join(part))
        which = np.searchsorted(offsets, starts, side="right") - 1
        yield which + begin, starts - offsets[which], ends - offsets[which]
        begin = end


_ROW_SPANS = "chunk_id string, starts array<int>, ends array<int>"


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of each row of a batch in one row."""
    for batch in batches:
        ids, texts = batch["chunk_id"].to_numpy(), batch["text"].tolist()
        for which, starts, ends in batch_spans(texts):
            rows, first = np.unique(which, return_index=True)
            if not len(rows):
                continue
            parted = [np.split(x.astype(np.int32), first[1:]) for x in (starts, ends)]
            yield pd.DataFrame({"chunk_id": ids[rows], "starts": parted[0], "ends": parted[1]})


def split_sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, start_pos, end_pos) of every sentence of every distinct chunk, in characters.

    Null, empty and blank texts have no sentences, rows without chunk_id are left out, and a chunk delivered more than once
    counts once: the places of its sentences, not its texts, are shuffled and made distinct, and should its texts differ, the greatest list
    of places counts. Every visible character is in exactly one sentence.
    """
    rows = chunks.select("chunk_id", "text").where("chunk_id IS NOT NULL AND length(text) > 0").mapInPandas(_spans, _ROW_SPANS)
    once = rows.groupBy("chunk_id").agg(F.max(F.struct("starts", "ends")).alias("x"))
    return once.select("chunk_id", F.inline(F.arrays_zip("x.starts", "x.ends"))).toDF("chunk_id", "start_pos", "end_pos")
