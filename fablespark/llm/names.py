"""Linking the spellings of one character or group.

Spellings are parsed into tokens; a symmetric-delete index over the tokens (every token with up to two letters left out) finds the
spellings that are a few edits apart without comparing all of them. With the stated aliases these give loose components, in which
spellings are aligned token by token with an optimal assignment that permits typing errors, initials, abbreviations,
short forms and reordered parts, and are clustered so that near namesakes stay apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fablespark.llm.grouping import connected_groups
from fablespark.runtime import cut, list_or_empty

# --- Fixed values ------------------------------------------------------------------------------------------------------------

TITLES = {"mr", "mrs", "ms", "miss", "mstr", "master", "mister", "mistress", "dr", "doctor", "prof", "professor", "capt", "captain", "lady", "lord", "sir", "dame", "brother", "sister", "father", "mother", "saint", "st", "ser", "warden", "elder", "abbot", "abbess", "squire", "steward", "marshal", "magister", "don", "frau", "herr", "madame", "mme", "monsieur"}
SMALL_WORDS = {"of", "the", "o", "ye", "and", "de"}
HEADS = {"house", "league", "council", "brotherhood", "sisterhood", "guild", "company", "order", "wardens", "circle", "court", "clan", "tribe", "band", "society", "fellowship", "union", "legion", "army", "family", "church", "college", "alliance", "watch"}
SHORT_FORM_ENDS = ("kin", "ie", "y", "o")
#: Cyrillic letters as they transcribe Latin ones.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщыэюя", ("a", "b", "v", "g", "d", "e", "j", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sh", "i", "e", "u", "a")))
MISREAD = str.maketrans({"0": "o", "1": "l", "5": "s", "|": "l"})
#: Letters that are written for one another by ear.
BY_EAR = str.maketrans({"c": "k", "q": "k", "y": "i", "w": "v", "z": "s"})
VOWELS = set("aeiouy")

_PARTED = re.compile(r"^(.+), \S{1,4} \S{2,4} (\S.*)$")
_QUOTED = re.compile(r"\s['\"‘“][^'\"’”]+['\"’”](?=\s)")


@lru_cache(100_000)
def plain_letters(text: str) -> str:
    """Lower-case letters without accents, Cyrillic transcribed, digits among Latin letters read as the letters they stand for."""
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")).lower()
    if any("а" <= c <= "я" for c in text):
        text = "".join(CYRILLIC.get(c, c) for c in text)
    return re.sub(r"(?<=[a-z])[015|]|[015|](?=[a-z])", lambda m: m.group().translate(MISREAD), text)


@lru_cache(100_000)
def fold(token: str) -> str:
    """A token by its sound and shape."""
    return token.translate(BY_EAR).replace("rn", "m").replace("oo", "u")


def parse(entity_type: str, text: str) -> tuple[str, str, str, str]:
    """(kind, first, second, prefix) of a spelling.

    ``full`` has two parts: given and family name, or head and rest of a group's name with its initials as prefix; the tokens of a part are
    set apart by a space where there are three or more in all. ``single`` has one part, with what is known of the beginning of the other as
    prefix. ``acronym`` has the letters. ``epithet`` is taken as it stands, and so is what has no letters of any script.
    """
    spaced = re.sub(r"\s+", " ", text).strip()
    low = plain_letters(spaced)
    kind, first, second, prefix = _parse_group(low) if entity_type == "group" else _parse_person(low)
    return (kind, first, second, prefix) if first else ("epithet", low, "", "")


def _parse_person(low: str) -> tuple[str, str, str, str]:
    if low.startswith(("the ", "my ", "our ")):
        return "epithet", low, "", ""
    low = _QUOTED.sub("", low)
    parted = _PARTED.match(low)
    if parted:
        given, family = parted.groups()
        return _person([given], [family[:-1] if family.endswith("s") else family])
    if "," in low:
        family, _, given = low.partition(",")
        return _person(given.split(), family.split())
    words = low.split()
    return _person(words[:1], words[1:])


def only_letters(word: str, more: str = "") -> str:
    """The letters of any script, with the vowel signs that belong to them."""
    return word if word.isascii() and word.isalpha() else "".join(c for c in word if c in more or unicodedata.category(c)[0] in "LM")


def _letters(words: list[str]) -> list[str]:
    return [x for x in (only_letters(re.sub(r"^d['’]", "", w)) for w in words) if x]


def _one_edit(word: str, listed: set[str], least: int) -> bool:
    """Whether a word is one edit from a listed word of ``least`` letters or more."""
    letters = set(word)
    return any(len(x) >= least and abs(len(x) - len(word)) <= 1 and len(letters ^ set(x)) <= 2 and distance(x, word) == 1 for x in listed)


@lru_cache(100_000)
def _is_title(word: str) -> bool:
    return word in TITLES or (len(word) >= 3 and _one_edit(word, TITLES, 4))


def _person(given: list[str], family: list[str]) -> tuple[str, str, str, str]:
    a, b = _letters(given), _letters(family)
    if a and b and (_is_title(a[0]) or (len(a[0]) > 1 and given[0].endswith("."))):
        a = []
    if sum(map(len, a)) == 1:  # further initials say no more than the first
        while len(b) > 1 and len(b[0]) == 1:
            b = b[1:]
    one, two = "".join(a), "".join(b)
    if len(one) > 1 and len(two) > 1:
        return ("full", " ".join(a), " ".join(b), "") if len(a) + len(b) > 2 else ("full", one, two, "")
    long, short = (one, two) if len(one) > len(two) else (two, one)
    return ("single", long, "", short) if len(long) > 1 else ("epithet", long + short, "", "")


@lru_cache(100_000)
def _is_head(word: str) -> bool:
    return word in HEADS or (len(word) >= 4 and _one_edit(word, HEADS, 0))


def _is_small(word: str) -> bool:
    """Whether a word is one of the small words, or "the" or "of" with one typing error."""
    return word in SMALL_WORDS or (len(word) == 3 and distance(word, "the") == 1) or word == "fo"


def _parse_group(low: str) -> tuple[str, str, str, str]:
    if "," in low:
        rest, _, head = low.partition(",")
        low = f"{head} {rest}"
    words = [only_letters(w, ".") for w in low.replace("-", " ").split()]
    words = [w for w in words if w.strip(".") and not _is_small(w)]
    if not words:
        return "epithet", low, "", ""
    if len(words) == 1 and len(words[0]) <= 5:
        return "acronym", words[0].replace(".", ""), "", ""
    short = [w for w in words if w.endswith(".") and len(w) > 2]
    if short:
        return "single", "".join(w for w in words if w not in short).replace(".", ""), "", short[0].rstrip(".")
    words = [w.replace(".", "") for w in words]
    head = next((w for w in (words[0], words[-1]) if _is_head(w)), "")
    if not head or len(words) == 1:
        return "single", "".join(words), "", ""
    words.remove(head)
    return "full", head, "".join(words), head[0] + "".join(w[0] for w in words)


def distance(a: str, b: str) -> int:
    """Edits between two tokens: insertion, deletion, replacement or exchange of neighbours."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    if not a or not b:
        return len(a) or len(b)
    last2: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last2[j - 2] + 1)
            row.append(cost)
        last2, last = last, row
    return last[-1]


NAMESAKE, UNLIKE = "namesake", "unlike"


def _whole_words(token: str) -> bool:
    """Whether the script of a token writes words or syllables, so that one character less or another is another name."""
    return token[:1] >= "\u0e00"


@lru_cache(500_000)
def compare(a: str, b: str) -> float | str:
    """Cost of taking b for a: 0 to 2 for one token spelt twice, NAMESAKE for one inner letter replaced by another of its kind.

    Tokens of a script whose characters are words or syllables are the same or unlike.
    """
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > 3 or _whole_words(a) or _whole_words(b):
        return UNLIKE
    if fold(a) == fold(b):
        return 0.5
    if abs(len(a) - len(b)) > 2 or len(set(a) ^ set(b)) > 4 and len(set(fold(a)) ^ set(fold(b))) > 4:
        return UNLIKE
    edits = min(distance(a, b), distance(fold(a), fold(b)))
    if edits == 1:
        if len(a) == len(b):
            at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), 0)
            if 0 < at < len(a) - 1 and a[at + 1 :] == b[at + 1 :] and (a[at] in VOWELS) == (b[at] in VOWELS):
                return NAMESAKE
        return 1.0
    if edits == 2 and min(len(a), len(b)) >= 5:
        return 2.0
    return UNLIKE


def _stems(short: str) -> list[str]:
    """A token without each of its short-form endings, of two letters or more."""
    return [short[: -len(end)] for end in SHORT_FORM_ENDS if len(short) - len(end) >= 2 and short.endswith(end)]


def _short_form(short: str, name: str) -> bool:
    return any(name.startswith(stem) for stem in _stems(short))


@lru_cache(200_000)
def align(known: tuple[str, str], other: tuple[str, str]) -> float | str:
    """Cost of the best assignment of the other spelling's parts to the known given name and family name.

    Parts are compared without their spaces first; spellings of three tokens or more are then also assigned token by token.
    """
    best = _align_parts(tuple(x.replace(" ", "") for x in known), tuple(x.replace(" ", "") for x in other))
    if best == UNLIKE and any(" " in x for x in (*known, *other)):
        return assign(" ".join(known).split(), " ".join(other).split())
    return best


def _align_parts(known: tuple[str, str], other: tuple[str, str]) -> float | str:
    best: float | str = UNLIKE
    for given, family in permutations(other):
        f = compare(known[1], family)
        f = 1.0 if f == NAMESAKE else f
        if f == UNLIKE:
            continue
        g = compare(known[0], given)
        if g in (UNLIKE, 2.0) and (_short_form(given, known[0]) or _short_form(known[0], given)):
            g = 1.0
        if g == NAMESAKE:
            best = NAMESAKE if best == UNLIKE else best
        elif g != UNLIKE and f + g <= 2.5 and (isinstance(best, str) or f + g < best):
            best = f + g
    return best


def _token_cost(a: str, b: str) -> float:
    """Cost of one token for another: an initial stands for the tokens that begin with it, a short form for its names."""
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else inf
    cost = compare(a, b)
    if cost == UNLIKE and (_short_form(a, b) or _short_form(b, a)):
        return 1.0
    return inf if isinstance(cost, str) else cost


def assign(a: list[str], b: list[str], left_out: float = 1.0) -> float | str:
    """Cost of the optimal assignment of the tokens of the shorter list, in any order, to those of the longer one.

    Every token of the shorter list has a partner; the longer one's first and last, and two of them at least, are partners; each of
    its other tokens that is left out costs ``left_out``. Found by the shortest augmenting paths of the Hungarian method.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2:
        return UNLIKE
    n, m, far = len(a), len(b), 1e6
    need = 1e3  # leaving out the first or last token costs more than any assignment
    cost = [[min(_token_cost(x, y), far) - (need if j in (0, m - 1) else left_out) for j, y in enumerate(b)] for x in a]
    row_of, u, v = [0] * (m + 1), [0.0] * (n + 1), [0.0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, before, done = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[at] = True
            row, step, following = row_of[at], inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], before[j] = reduced, at
                    if least[j] < step:
                        step, following = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = following
            if not row_of[at]:
                break
        while at:
            row_of[at] = row_of[before[at]]
            at = before[at]
    total = sum(_token_cost(a[row_of[j] - 1], b[j - 1]) if row_of[j] else inf if j in (1, m) else left_out for j in range(1, m + 1))
    return total if total <= 2.5 else UNLIKE


def align_single(known: tuple[str, str], token: str, prefix: str) -> float | str:
    """Cost of taking one part, and perhaps the beginning of the other, for a full name."""
    best: float | str = UNLIKE
    for part, other in (known[::-1], known):
        if prefix and not other.startswith(prefix):
            continue
        cost = compare(part, token)
        cost = 1.0 if cost == NAMESAKE and part == known[1] else cost
        if cost in (UNLIKE, 2.0) and not prefix and _short_form(token, part):
            cost = 1.5
        if not isinstance(cost, str) and cost <= 1.5 and (isinstance(best, str) or cost < best):
            best = cost
    return best


# --- Index -------------------------------------------------------------------------------------------------------------------


def deletes(token: str, most: int) -> set[str]:
    """A token with up to ``most`` letters left out."""
    found = {token}
    for k in range(1, min(most, len(token) - 1) + 1):
        found |= {"".join(token[i] for i in keep) for keep in combinations(range(len(token)), len(token) - k)}
    return found


def _spelt(token: str) -> set[str]:
    """A token folded, with and without its letter groups: an edit inside a group shows in the second only."""
    return {fold(token), token.translate(BY_EAR)}


@lru_cache(200_000)
def _hashed(token: str, most: int) -> np.ndarray:
    """Hashes of a token's spellings with up to ``most`` letters left out."""
    return np.array([xxh64_intdigest(x) for x in {x for t in _spelt(token) for x in deletes(t, most)}], dtype=np.uint64)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, None] + b[None, :]).ravel()


def _pair_keys(a: str, b: str) -> list[np.ndarray]:
    """Keys of two parts with two letters left out in all; a sum has no order, so an edit that changes which part comes first does no harm."""
    return [_sums(_hashed(a, m), _hashed(b, n)) for m, n in ((2, 0), (0, 2), (1, 1))]


def index_keys(kind: str, first: str, second: str, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys under which two full spellings meet, keys under which a partial spelling meets full ones), as hashes."""
    none = np.zeros(0, dtype=np.uint64)
    if kind == "full":
        tokens = [t for t in f"{first} {second}".split() if len(t) > 1]
        parts = first.replace(" ", ""), second.replace(" ", "")
        pairs = _pair_keys(*parts)
        if len(tokens) > 2 or " " in first + second:
            for a, b in combinations(tokens[:3] + tokens[3:][-3:], 2):
                pairs += _pair_keys(a, b)
        begun = {f"{t[:n]}~" for t in parts for n in range(2, min(len(t), _STEM) + 1)}  # short forms meet the names that begin with their stem
        texts = begun | ({f"={prefix}"} if prefix else set())
        return np.unique(np.concatenate(pairs)), np.concatenate([_hashed(parts[0], 1), _hashed(parts[1], 1), _plain(texts)])
    if kind == "single":
        return none, np.concatenate([_hashed(first, 1), _plain(set() if prefix else {f"{stem[:_STEM]}~" for stem in _stems(first)})])
    return none, _plain({f"={first}"}) if kind == "acronym" else none


#: Letters of a stem that its key has.
_STEM = 12


def _plain(texts: set[str]) -> np.ndarray:
    return np.array([xxh64_intdigest(t) for t in texts], dtype=np.uint64)


def _short_full(kind: str, first: str, second: str) -> bool:
    return kind == "full" and any(_stems(t) for t in (first, second))


_PARSED = "book_num int, entity_type string, text string, node long, kind string, first string, second string, prefix string, partial boolean"
_KEYS = "node long, partial boolean, pair_keys array<long>, part_keys array<long>"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for book, kind_of, text in batch.itertuples(index=False):
            kind, first, second, prefix = parse(kind_of, text)
            node = xxh64_intdigest(f"{book}|{kind_of}|{kind}|{first}|{second}|{prefix}") - (1 << 63)
            rows.append((book, kind_of, text, node, kind, first, second, prefix, kind in ("single", "acronym") or _short_full(kind, first, second)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARSED.split(", ")])


def _key_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each node, those of different books and types apart."""
    for batch in batches:
        rows = []
        for node, book, kind_of, kind, first, second, prefix, partial in batch.itertuples(index=False):
            place = np.uint64(xxh64_intdigest(f"{book}|{kind_of}"))
            rows.append((node, partial, *((np.unique(k) * np.uint64(0x9E3779B97F4A7C15) ^ place).view(np.int64) for k in index_keys(kind, first, second, prefix))))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _KEYS.split(", ")])


def _meet(rows: DataFrame, partial_only: bool, rows_per_hub: int = 5_000_000) -> DataFrame:
    """Star edges (u, v) between the nodes (node, partial) that share a key, where that matters: in sub-groups of a key, then between these."""
    salts = 1 + rows.count() // rows_per_hub
    if partial_only and salts > 1:
        rows = rows.join(rows.where("partial").select("key").distinct(), "key", "left_semi")
    w = Window.partitionBy("key", "salt") if salts > 1 else Window.partitionBy("key")
    met = rows.withColumn("salt", F.pmod(F.col("node"), F.lit(salts))).withColumn("hub", F.min("node").over(w))
    if partial_only and salts == 1:
        met = met.withColumn("any", F.max("partial").over(w)).where("any")
    edges = met.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    if salts > 1:
        top = F.min("node").over(Window.partitionBy("key"))
        edges = edges.unionByName(met.where("node = hub").withColumn("top", top).where("node <> top").select(F.col("node").alias("u"), F.col("top").alias("v")))
    return edges.distinct()


# --- Clusters ------------------------------------------------------------------------------------------------------------------


def cluster(nodes: list[tuple[str, str, str, str, str, int]], stated: list[tuple[str, str]]) -> dict[str, str]:
    """Node -> name of its cluster, for one loose component.

    ``nodes`` are (node, kind, first, second, prefix, support); ``stated`` are (node of a name, node of an alias in its row).
    Full spellings are taken from the best supported down: one joins the cluster it costs least to align with, if that is one
    cluster only. Partial spellings and epithets join the one cluster that statements name, else the one they fit.
    """
    parent: dict[str, str] = {n[0]: n[0] for n in nodes}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    full = {n[0]: (n[2], n[3]) for n in nodes if n[1] == "full"}
    parts = {n: (a.replace(" ", ""), b.replace(" ", "")) for n, (a, b) in full.items()}
    initials = {n[0]: n[4] for n in nodes if n[1] == "full"}
    support = {n[0]: n[5] for n in nodes}
    for a, b in stated:
        if a in full and b in full:
            parent[root(a)] = root(b)
    heads: dict[str, list[str]] = defaultdict(list)
    for node in sorted(full, key=lambda n: (-support[n], n)):
        heads[root(node)].append(node)
    near = _costs(heads, full)
    # A spelling as near to two namesakes is either's, and joins nobody.
    nearest = {h: _nearest(near[h]) for h in heads}
    either = {h for h, best in nearest.items() if any(near[x].get(y) == NAMESAKE for x, y in combinations(best, 2))}
    done: set[str] = set()
    for own in sorted(heads.keys() - either, key=lambda r: (-sum(support[n] for n in heads[r]), r)):
        apart = {root(o) for o, c in near[own].items() if c == NAMESAKE and o in done}
        best = _nearest({o: c for o, c in near[own].items() if o not in either})
        for target in sorted({root(o) for o in best if o in done} - apart):
            parent[root(own)] = root(target)
        done.add(own)
    members: dict[str, list[str]] = defaultdict(list)
    for node in full:
        members[root(node)].append(node)
    said: dict[str, Counter] = defaultdict(Counter)
    for a, b in stated:
        said[a][b] += 1
        said[b][a] += 1
    waiting = [n for n in nodes if n[1] != "full"]
    while True:  # what has found its place may tell others theirs
        left = []
        for n in sorted(waiting, key=lambda n: (n[1] != "single", -n[5], n[0])):
            node, kind, first, _second, prefix, _ = n
            told = {root(x) for x in said[node] if root(x) in members and root(x) != node}
            if kind == "epithet" and len(told) > 1:
                told = _one_family(told, members, parts, parent)
            if len(told) == 1:
                home = told.pop()
            elif not told and kind in ("single", "acronym"):
                home = _fitting(kind, first, prefix, members, parts, initials)
            else:
                home = None
            if home is None:
                left.append(n)
            else:
                parent[node] = home
        if len(left) == len(waiting):
            break
        waiting = left
    _link_singles(waiting, members, parts, said, root, parent)
    # What fits no full name may still be stated to be another partial spelling.
    for n in waiting:
        for other in said[n[0]]:
            if root(other) not in members and root(other) != root(n[0]):
                parent[root(n[0])] = root(other)
    return {n[0]: root(n[0]) for n in nodes}


def _link_singles(waiting: list[tuple], members: dict, parts: dict, said: dict, root, parent: dict[str, str]) -> None:
    """Joins spellings of one part that fit no full name and are said to be nothing else: each to the one nearest group of the better supported."""
    alone = [n for n in waiting if n[1] == "single" and not n[4] and len(n[2]) > 4 and not said[n[0]]]
    alone = [n for n in alone if all(isinstance(align_single(parts[m], n[2], ""), str) for nodes in members.values() for m in nodes)]
    done: list[tuple] = []
    for n in sorted(alone, key=lambda n: (-n[5], n[0])):
        costs = {o[0]: compare(o[2], n[2]) for o in done}
        apart = {root(o) for o, c in costs.items() if c == NAMESAKE}
        near = {root(o) for o, c in costs.items() if not isinstance(c, str) and c <= 1.0} - apart
        if len(near) == 1:
            parent[root(n[0])] = near.pop()
        done.append(n)


def _meeting(heads: dict[str, list[str]], full: dict[str, tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Pairs of groups that may align: all in a small component, those that share a key of the index in a large one."""
    if len(heads) <= 40:
        yield from combinations(sorted(heads), 2)
        return
    by_key, seen = defaultdict(set), set()
    for h, nodes in heads.items():
        for n in nodes:
            for k in {x for keys in index_keys("full", *full[n], "") for x in keys.tolist()}:
                by_key[k].add(h)
    for met in by_key.values():
        for pair in combinations(sorted(met), 2):
            if pair not in seen:
                seen.add(pair)
                yield pair


def _costs(heads: dict[str, list[str]], full: dict[str, tuple[str, str]]) -> dict[str, dict[str, float | str]]:
    """For each group of stated equals the cost of aligning it with each other group, NAMESAKE where that is all there is."""
    near: dict[str, dict[str, float | str]] = {h: {} for h in heads}
    for x, y in _meeting(heads, full):
        found = [c for a in heads[x] for b in heads[y] if (c := align(full[a], full[b])) != UNLIKE]
        numbers = [c for c in found if c != NAMESAKE]
        if found:
            # Namesakes stay apart unless one of the spellings is the very same.
            near[x][y] = near[y][x] = min(numbers) if numbers and (len(numbers) == len(found) or 0.0 in numbers) else NAMESAKE
    return near


def _nearest(costs: dict[str, float | str]) -> list[str]:
    numbers = {o: c for o, c in costs.items() if c != NAMESAKE}
    least = min(numbers.values(), default=None)
    return [o for o, c in numbers.items() if c == least]


def _one_family(told: set[str], members: dict[str, list[str]], full: dict[str, tuple[str, str]], parent: dict[str, str]) -> set[str]:
    """Unites clusters that share an epithet and a family name and aren't namesakes; the clusters then told."""
    first, *rest = sorted(told, key=lambda r: (-len(members[r]), r))
    for other in rest:
        pairs = [(full[a], full[b]) for a in members[first] for b in members[other]]
        if all(align(a, b) != NAMESAKE for a, b in pairs) and any(compare(a[1], b[1]) in (0.0, 0.5, 1.0, NAMESAKE) for a, b in pairs):
            parent[other] = first
            members[first] += members.pop(other)
    return {r for r in told if r in members}


def _fitting(kind: str, first: str, prefix: str, members: dict[str, list[str]], full: dict[str, tuple[str, str]], initials: dict[str, str]) -> str | None:
    costs: dict[str, float] = {}
    for home, nodes in members.items():
        for node in nodes:
            cost = align_single(full[node], first, prefix) if kind == "single" else 0.0 if first == initials[node] else UNLIKE
            if not isinstance(cost, str):
                costs[home] = min(cost, costs.get(home, 9.0))
    if not costs:
        return None
    least = min(costs.values())
    best = [h for h, c in costs.items() if c <= least]
    return best[0] if len(best) == 1 else None


def _clusters(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """(node, cluster) of one component; within it a node goes by its parsed parts, so that ties do not hang on hashes."""
    by_node = {r[1]: "|".join(r[2:6]) for r in rows}
    node_of = {spelt: node for node, spelt in by_node.items()}
    stated = [(by_node[r[1]], by_node[b]) for r in rows for b in r[7] if b in by_node]
    homes = cluster([(by_node[r[1]], *r[2:7]) for r in rows], stated)
    return ((node_of[n], node_of[h]) for n, h in homes.items())


def _cluster_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters of whole components, whose rows come next to each other."""
    waiting: list[tuple] = []
    for batch in batches:
        done: list[tuple[int, int]] = []
        for row in batch[["component", "node", "kind", "first", "second", "prefix", "support", "aliases_of"]].itertuples(index=False, name=None):
            if waiting and row[0] != waiting[0][0]:
                done += _clusters(waiting)
                waiting = []
            waiting.append(row)
        yield pd.DataFrame(done, columns=["node", "cluster"], dtype=None if done else "int64")
    if waiting:
        yield pd.DataFrame(list(_clusters(waiting)), columns=["node", "cluster"])


# --- Operator ------------------------------------------------------------------------------------------------------------------


def name_clusters(entities: DataFrame) -> DataFrame:
    """(book_num, entity_type, name, cluster) of every distinct stored name of a character or group that is not blank.

    Names denote the same entity if they have the same cluster. Rows with a null book or name give nothing; null and blank aliases
    and aliases written without any capital (``the captain``), which fit several, state nothing; repeated rows count as support. Names
    of any script are read; what has no letters at all is only what it is written as. Parsed spellings go by a hash of 64 bits.
    """
    rows = entities.where("entity_type IN ('character', 'group') AND book_num IS NOT NULL AND length(trim(name)) > 0").select("book_num", "entity_type", "name", "aliases")
    telling = F.filter(list_or_empty(F.col("aliases")), lambda a: a.isNotNull() & (F.trim(a) != "") & ~((F.lower(a) == a) & F.lower(a).rlike("^(the|my|our) ")))
    place = ["book_num", "entity_type"]
    # (name, alias or null, rows): what every row says, counted; a name's own support is in the rows without alias.
    said_by = rows.select(*place, "name", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(telling))).alias("alias"))
    said_by = cut(said_by.groupBy(*place, "name", "alias").agg(F.count("*").alias("rows")))
    names = said_by.where("alias IS NULL").select(*place, "name", "rows")
    alias_rows = said_by.where("alias IS NOT NULL").select(*place, "name", "alias")
    texts = said_by.select(*place, F.coalesce("alias", "name").alias("text")).distinct()
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, costly to parse: keep all partitions
    parsed = cut(texts.repartition(tasks).mapInPandas(_parse_batches, _PARSED))
    of_name = parsed.select(*place, F.col("text").alias("name"), F.col("node").alias("name_node"))
    of_alias = parsed.select(*place, F.col("text").alias("alias"), F.col("node").alias("alias_node"))
    stated = cut(alias_rows.join(of_name, [*place, "name"]).join(of_alias, [*place, "alias"]).where("name_node <> alias_node").select("name_node", "alias_node").distinct())
    columns = ("kind", "first", "second", "prefix", "partial")
    nodes = cut(parsed.groupBy("node", *place).agg(*[F.first(c).alias(c) for c in columns]))
    keyed = cut(nodes.select("node", *place, *columns).mapInPandas(_key_batches, _KEYS))
    pairs = _meet(keyed.select("node", "partial", F.explode("pair_keys").alias("key")), partial_only=False)
    parts = _meet(keyed.select("node", "partial", F.explode("part_keys").alias("key")), partial_only=True)
    components = connected_groups(pairs.unionByName(parts).unionByName(stated.toDF("u", "v"))).toDF("node", "component")
    said = stated.groupBy("name_node").agg(F.collect_set("alias_node").alias("aliases_of")).withColumnRenamed("name_node", "node")
    support = names.join(of_name, [*place, "name"]).groupBy("name_node").agg(F.sum("rows").alias("support")).withColumnRenamed("name_node", "node")
    members = (
        nodes.select("node", "kind", "first", "second", "prefix")
        .join(components, "node")
        .join(said, "node", "left")
        .join(support, "node", "left")
        .select("component", "node", "kind", "first", "second", "prefix", F.coalesce("support", F.lit(0)).alias("support"), list_or_empty(F.col("aliases_of"), "array<long>").alias("aliases_of"))
    )
    clustered = members.repartition(tasks, "component").sortWithinPartitions("component", "node").mapInPandas(_cluster_batches, "node long, cluster long")
    return names.select(*place, "name").join(of_name, [*place, "name"]).join(clustered, F.col("name_node") == F.col("node"), "left").select(*place, "name", F.coalesce("cluster", "name_node").alias("cluster"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """(book_num, entity_type, name_a, name_b): the pairs of stored names of one entity, name_a before name_b."""
    linked = cut(name_clusters(entities))
    a = linked.select("book_num", "entity_type", "cluster", F.col("name").alias("name_a"))
    b = linked.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").where("name_a < name_b").select("book_num", "entity_type", "name_a", "name_b")
