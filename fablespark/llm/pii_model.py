"""Character-level bidirectional LSTM with CRF transitions: inference in numpy.

Gates are piecewise linear and the forget gate is one minus the input gate, so that a step is a table look-up of the input gates,
one matrix product for both directions, and cheap array operations. Texts are laid into rows of one width: a short text is whole in
one row, apart from others by a symbol that sets the state back to nothing, so no text knows of its neighbours; a long one is cut into
overlapping windows. Each half of an overlap takes its scores from the window that sees more on both sides, windows are decoded with
the Viterbi algorithm, and their tags are spliced where both decode the same tag outside of any span, so a span is never cut by a window.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ["person", "email", "phone", "id_number", "address"]
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on with it
WIDTH, OVERLAP, ROWS = 2048, 288, 512
#: Windows of a long text that are scored together; the next ones overlap them like any others.
SEGMENT = 256
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

#: Script of characters that have no symbol of their own, as ranges of code points.
SCRIPTS = [(0x0000, 0x007F), (0x0080, 0x024F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0E00, 0x0E7F), (0x2000, 0x206F), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF)]
#: Symbol 0 stands for any other character, 1 for the gap between texts: the first of two silences the cells, the second empties them.
GAP, GAPS = 1, 2


def first_own_symbol() -> int:
    return 4 * (len(SCRIPTS) + 1)


def symbol_table(own: str) -> np.ndarray:
    """Symbol of every code point: its own, or that of its script and kind of character."""
    table = np.zeros(65536, dtype=np.int16)
    for k, (first, last) in enumerate(SCRIPTS, 1):
        for code in range(first, last + 1):
            c = chr(code)
            table[code] = 4 * k + (1 if c.isdigit() else 2 if c.isupper() else 3 if c.isalpha() else 0)
    for k, c in enumerate(own):
        table[ord(c)] = first_own_symbol() + k
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return table[np.minimum(codes, 65535)]


class Tagger:
    """The trained network: per direction the input gates E of each symbol (input, output, candidate), recurrent U, and V to the tags."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.table = symbol_table(str(weights["own"]))
        f32 = {k: v.astype(np.float32) for k, v in weights.items() if k != "own"}
        n = self.hidden = f32["Uf"].shape[0]
        # The linear part of a gate is x / 4 + 1 / 2; both numbers go into the weights.
        scale = np.repeat(np.array([0.25, 0.25, 1], np.float32), n)
        shift = np.repeat(np.array([0.5, 0.5, 0], np.float32), n)
        self.inputs = []
        for d in "fb":
            table = (f32[f"E{d}"] + f32[f"b{d}"]) * scale + shift
            table[GAP, : 2 * n], table[GAP, 2 * n :] = [1e6] * n + [-1e6] * n, 0  # takes in nothing, forgets all, tells nothing
            self.inputs.append(np.ascontiguousarray(table))
        self.recurrent = np.stack([f32[f"U{d}"] * scale for d in "fb"])
        self.out = np.stack([f32[f"V{d}"] for d in "fb"])
        self.out_bias, self.transitions, self.start = f32["vb"], f32["T"], f32["s"]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (time, tag, row) of symbol ids (time, row); both directions go step by step together."""
        steps, rows = ids.shape
        n = self.hidden
        scores = np.empty((steps, TAGS, rows), dtype=np.float32)
        scores[:] = self.out_bias[:, None]
        z, z2, low, high = (np.empty((2, rows, 3 * n), dtype=np.float32) for _ in range(4))
        low[..., : 2 * n], low[..., 2 * n :], high[:] = 0, -1, 1
        h, c, t = (np.zeros((2, rows, n), dtype=np.float32) for _ in range(3))
        part = np.empty((2, rows, TAGS), dtype=np.float32)
        i, o, g = (z[..., k * n : (k + 1) * n] for k in range(3))
        forth, back = self.inputs
        for at in range(steps):
            np.take(forth, ids[at], axis=0, out=z[0], mode="clip")
            np.take(back, ids[steps - 1 - at], axis=0, out=z[1], mode="clip")
            np.matmul(h, self.recurrent, out=z2)
            z += z2
            np.maximum(z, low, out=z)
            np.minimum(z, high, out=z)
            np.subtract(g, c, out=t)
            t *= i
            c += t
            np.multiply(o, c, out=h)
            np.matmul(h, self.out, out=part)
            scores[at] += part[0].T
            scores[steps - 1 - at] += part[1].T
        at, row = np.nonzero(ids == GAP)
        scores[at, 1:, row] = -1e4
        return scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tag sequences (time, row); ``scores`` is overwritten with the scores of the best paths.

        A span begins after what is outside of any, and goes on from its own kind; the outside is entered from any tag.
        """
        steps, _, rows = scores.shape
        scores[0] += self.start[:, None]
        T, first, on = self.transitions, np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        leave, begin, begun, going = T[:, :1], T[0, first][:, None], T[first, on][:, None], T[on, on][:, None]
        out = np.empty((TAGS, rows), dtype=np.float32)
        a, b = (np.empty((len(on), rows), dtype=np.float32) for _ in range(2))
        before = np.zeros((steps, TAGS, rows), dtype=np.int8)  # the tag before each tag on its best path
        for t in range(1, steps):
            last, now = scores[t - 1], scores[t]
            np.add(last, leave, out=out)
            now[0] += out.max(axis=0)
            np.add(begin, last[0], out=a)
            now[1::2] += a
            np.add(last[1::2], begun, out=a)
            np.add(last[2::2], going, out=b)
            np.greater(b, a, out=before[t, 2::2], casting="unsafe")
            np.maximum(a, b, out=a)
            now[2::2] += a
        before[:, 2::2] += first.astype(np.int8)[:, None]
        best, other = (np.empty((steps - 1, rows), dtype=np.float32) for _ in range(2))
        np.add(scores[:-1, 0], T[0, 0], out=best)
        for s in range(1, TAGS):
            np.add(scores[:-1, s], T[s, 0], out=other)
            np.copyto(before[1:, 0], s, where=other > best)
            np.maximum(best, other, out=best)
        tags = np.empty((steps, rows), dtype=np.int8)
        tags[-1], each = scores[-1].argmax(axis=0), np.arange(rows)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = before[t][tags[t], each]
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, end, kind) of its spans, in order and without overlap; each text's are the same whatever stands beside it."""
        ids = [symbols(t, self.table) for t in texts]
        tags = [np.zeros(len(x), dtype=np.int8) for x in ids]
        half = OVERLAP // 2
        for units in _batches([u for k, x in enumerate(ids) for u in _units(k, len(x))]):
            places, rows = _rows(units)
            grid = np.full((WIDTH + 2, -(-rows // 64) * 64), GAP, dtype=np.intp)  # products of whole blocks round alike for every row
            for (k, a, b), (r, at) in places.items():
                grid[at : at + b - a, r] = ids[k][a:b]
            scores = self.emissions(grid)
            for unit in units:
                for (k, a, b), following in zip(unit, unit[1:]):  # each half of an overlap from the window that sees more around it
                    (r, at), (r2, at2) = places[k, a, b], places[following]
                    end = at + b - a
                    scores[end - half : end, :, r] = scores[at2 + half : at2 + OVERLAP, :, r2]
                    scores[at2 : at2 + half, :, r2] = scores[end - OVERLAP : end - half, :, r]
            found = self.decode(scores)
            for unit in units:
                for k, a, b in unit:
                    r, at = places[k, a, b]
                    own = found[at : at + b - a, r]
                    cut = splice(tags[k][a : a + OVERLAP], own[:OVERLAP]) if a else 0
                    tags[k][a + cut : b] = own[cut:]
        return [tag_spans(x) for x in tags]


Piece = tuple[int, int, int]  # text, start, end


def _units(text: int, length: int) -> list[list[Piece]]:
    """The windows of a text, all of about one width, in segments that are scored together; the windows of a long text overlap."""
    if not length:
        return []
    n = max(1, -(-(length - OVERLAP) // (WIDTH - OVERLAP)))
    step = (length - OVERLAP) / n if n > 1 else length
    edges = [round(k * step) for k in range(n)]  # window k goes from edge k to OVERLAP beyond the next one
    pieces = [(text, a, b + OVERLAP) for a, b in zip(edges, edges[1:])] + [(text, edges[-1], length)]
    return [pieces[k : k + SEGMENT] for k in range(0, n, SEGMENT)]


def _batches(units: list[list[Piece]]) -> list[list[list[Piece]]]:
    """Units in batches of about equal size, ``ROWS`` rows at most or one segment more."""
    size = lambda unit: sum(b - a + GAPS for _, a, b in unit)
    total = sum(map(size, units))
    if not total:
        return []
    most = total / -(-total // (ROWS * WIDTH))
    out, done = [[]], 0
    for unit in units:
        if done >= most * len(out):
            out.append([])
        out[-1].append(unit)
        done += size(unit)
    return out


def _rows(units: list[list[Piece]]) -> tuple[dict[Piece, tuple[int, int]], int]:
    """(row, place in it) of each piece, with gaps on both sides, and the number of rows: from the longest on, each goes where the least room is left that it fits."""
    places: dict[Piece, tuple[int, int]] = {}
    room: list[tuple[int, int]] = []  # (room left, row), in order
    rows = 0
    for piece in sorted((p for unit in units for p in unit), key=lambda p: (p[1] - p[2], p)):
        need = piece[2] - piece[1]
        at = bisect_left(room, (need, -1))
        left, row = room.pop(at) if at < len(room) else (WIDTH, rows)
        rows += row == rows
        places[piece] = row, 1 + WIDTH - left
        insort(room, (left - need - GAPS, row))
    return places, rows


def splice(left: np.ndarray, right: np.ndarray) -> int:
    """Where to pass from one window's tags to the next one's in their overlap: nearest to the middle where both are outside; else the middle."""
    both = np.flatnonzero((left == 0) & (right[: len(left)] == 0))
    middle = len(left) // 2
    return int(both[np.abs(both - middle).argmin()]) if len(both) else middle


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans of a tag sequence."""
    inside = tags > 0
    if not inside.any():
        return []
    edge = np.ones(len(tags), dtype=bool)
    edge[1:] = (tags[1:] != tags[:-1]) & ~((tags[1:] == tags[:-1] + 1) & (tags[1:] % 2 == 0))
    edge |= inside & (tags % 2 == 1)
    edges = np.flatnonzero(edge)
    stops = np.append(edges[1:], len(tags))
    keep = inside[edges]
    return [(int(a), int(b), (int(tags[a]) - 1) // 2) for a, b in zip(edges[keep], stops[keep])]


@lru_cache(1)
def trained() -> Tagger:
    """The tagger with the weights of this package, loaded once in a worker."""
    with np.load(WEIGHTS) as stored:
        return Tagger({k: stored[k] for k in stored.files})
