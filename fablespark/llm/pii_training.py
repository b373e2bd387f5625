"""Training of the personal-data tagger, in numpy, from labelled spans.

python -m fablespark.llm.pii_training TABLES_DIRECTORY [SAMPLE_DOCUMENTS SECONDS WORKERS [RATE UNITS]]

The labelled spans are made by ``pii_samples``: marked ones in a bounded sample of documents (``SAMPLE_DOCUMENTS`` rows at most), many
of them replaced by invented ones, and passages with invented ones only. The result is ``pii_weights.npz`` beside this file; with a rate the training goes on from the weights that are there, and with a number of units from so many of theirs.
Nothing here runs when documents are tagged.
"""

from __future__ import annotations

import random
import re
import sys
import time
from multiprocessing import get_context

import numpy as np

from fablespark.llm.pii_model import GAP, GAPS, KINDS, TAGS, WEIGHTS, Tagger, first_own_symbol, symbol_table, symbols
from fablespark.llm.pii_samples import Inventor, Marker, Span, varied


def lstm_forward(ids: np.ndarray, p: dict[str, np.ndarray], d: str) -> tuple[np.ndarray, list]:
    """States (time, row, unit) in one direction; gates are linear between 0 and 1, the candidate between -1 and 1."""
    steps, n = ids.shape[0], p[f"U{d}"].shape[0]
    h, c = np.zeros((ids.shape[1], n), np.float32), np.zeros((ids.shape[1], n), np.float32)
    out, kept = np.empty((steps, ids.shape[1], n), np.float32), [None] * steps
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        raw = p[f"E{d}"][ids[t]] + p[f"b{d}"] + h @ p[f"U{d}"]
        raw[:, : 2 * n] = raw[:, : 2 * n] * 0.25 + 0.5
        z = np.clip(raw, 0, 1)
        z[:, 2 * n :] = np.clip(raw[:, 2 * n :], -1, 1)
        before = c
        c = c + z[:, :n] * (z[:, 2 * n :] - c)
        kept[t] = (raw == z, z, before, c, h)
        h = z[:, n : 2 * n] * c
        out[t] = h
    return out, kept


def lstm_backward(ids: np.ndarray, p: dict[str, np.ndarray], d: str, kept: list, grad: np.ndarray, leak: float) -> dict[str, np.ndarray]:
    """Gradients; outside of a gate's linear part ``leak`` of the gradient goes through, so that no unit is stuck."""
    steps, n = ids.shape[0], p[f"U{d}"].shape[0]
    dE, dU = np.zeros_like(p[f"E{d}"]), np.zeros_like(p[f"U{d}"])
    dh, dc = np.zeros((ids.shape[1], n), np.float32), np.zeros((ids.shape[1], n), np.float32)
    dz_all = np.empty((steps, ids.shape[1], 3 * n), np.float32)
    slope = np.repeat(np.array([0.25, 0.25, 1], np.float32), n)
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        linear, z, before, c, h = kept[t]
        i, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n :]
        dh = dh + grad[t]
        dc = dc + dh * o
        dz = dz_all[t]
        dz[:, :n] = dc * (g - before)
        dz[:, n : 2 * n] = dh * c
        dz[:, 2 * n :] = dc * i
        dz *= np.where(linear, slope, slope * leak)
        dU += h.T @ dz
        dh, dc = dz @ p[f"U{d}"].T, dc * (1 - i)
    flat = dz_all.reshape(-1, 3 * n)
    order = np.argsort(ids.ravel(), kind="stable")
    first = np.flatnonzero(np.diff(ids.ravel()[order], prepend=-1))
    dE[ids.ravel()[order][first]] = np.add.reduceat(flat[order], first, axis=0)
    dE[GAP] = 0
    return {f"E{d}": dE, f"U{d}": dU, f"b{d}": flat.sum(axis=0)}

def crf_loss(scores: np.ndarray, tags: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(negative log likelihood per character, gradients of the scores, the transitions and the start)."""
    steps, rows, _ = scores.shape
    T, s = p["T"], p["s"]
    alpha = np.empty_like(scores)
    alpha[0] = s + scores[0]
    for t in range(1, steps):
        x = alpha[t - 1][:, :, None] + T
        top = x.max(axis=1)
        alpha[t] = np.log(np.exp(x - top[:, None]).sum(axis=1)) + top + scores[t]
    top = alpha[-1].max(axis=1)
    total = np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1)) + top
    beta = np.zeros((rows, TAGS), np.float32)
    gs, gT = np.empty_like(scores), np.zeros_like(T)
    for t in range(steps - 1, -1, -1):
        gs[t] = np.exp(alpha[t] + beta - total[:, None])
        if t:
            y = scores[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + T + y[:, None] - total[:, None, None])
            gT += pair.sum(axis=0)
            x = T + y[:, None]
            top = x.max(axis=2)
            beta = np.log(np.exp(x - top[:, :, None]).sum(axis=2)) + top
    k = np.arange(rows)
    gold = s[tags[0]] + scores[0, k, tags[0]]
    for t in range(1, steps):
        gold = gold + T[tags[t - 1], tags[t]] + scores[t, k, tags[t]]
    np.put_along_axis(gs, tags[:, :, None], np.take_along_axis(gs, tags[:, :, None], 2) - 1, 2)
    np.add.at(gT, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return float((total - gold).sum()) / tags.size, gs, gT, gs[0].sum(axis=0)


def allowed_transitions() -> np.ndarray:
    """A tag that goes on follows only its own kind."""
    T = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        T[:, 2 + 2 * k] = -30
        T[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return T


def gradients(ids: np.ndarray, tags: np.ndarray, p: dict[str, np.ndarray], leak: float = 0.1) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, gradients per character) of a batch of windows."""
    (hf, kf), (hb, kb) = (lstm_forward(ids, p, d) for d in "fb")
    scores = hf @ p["Vf"] + hb @ p["Vb"] + p["vb"]
    loss, gs, gT, g0 = crf_loss(scores, tags, p)
    flat = gs.reshape(-1, TAGS)
    g = {"T": gT, "s": g0, "vb": flat.sum(axis=0)}
    for d, h, kept in (("f", hf, kf), ("b", hb, kb)):
        g[f"V{d}"] = h.reshape(-1, h.shape[2]).T @ flat
        g |= lstm_backward(ids, p, d, kept, gs @ p[f"V{d}"].T, leak)
    return loss, {k: v / tags.size for k, v in g.items()}


_DATA: dict = {}


def _sampled_gradients(job: tuple) -> tuple[float, dict[str, np.ndarray]]:
    """Gradients on windows that a worker draws: most around spans, the others anywhere."""
    p, seed, rows, width = job
    rng = np.random.default_rng(seed)
    x, y, by_kind = _DATA["x"], _DATA["y"], _DATA["by_kind"]
    around = [rng.choice(by_kind[rng.choice(len(KINDS), p=[0.4, 0.12, 0.12, 0.12, 0.24])]) - rng.integers(0, width) for _ in range(rows * 7 // 12)]
    anywhere = rng.integers(0, len(x) - width, rows - len(around))
    window = np.clip(np.concatenate([around, anywhere]), 0, len(x) - width - 1)[None, :] + np.arange(width)[:, None]
    ids, gold = x[window], y[window]
    gold[0] = np.where((gold[0] > 0) & (gold[0] % 2 == 0), gold[0] - 1, gold[0])
    return gradients(ids, gold, p)


def initial(symbols_count: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random weights."""
    p = {"T": allowed_transitions(), "s": np.zeros(TAGS, np.float32), "vb": np.zeros(TAGS, np.float32)}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.25, (symbols_count, 3 * hidden)).astype(np.float32)
        p[f"E{d}"][GAP] = np.repeat(np.array([100, -100, 0], np.float32), hidden)
        p[f"U{d}"] = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        p[f"b{d}"] = np.repeat(np.array([-0.6, 0, 0], np.float32), hidden)
        p[f"V{d}"] = rng.normal(0, 0.3, (hidden, TAGS)).astype(np.float32)
    return p


def train(texts: list[str], spans: list[list[Span]], hidden: int = 16, steps: int = 1500, workers: int = 8, rows: int = 24, width: int = 192, seed: int = 1, seconds: float = 900, begin: dict[str, np.ndarray] | None = None, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Weights of the network, trained on windows of the texts, most of them around spans; ``begin`` may give weights to go on from."""
    rng = np.random.default_rng(seed)
    counts: dict[str, int] = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    own = str(begin["own"]) if begin else "".join(sorted(sorted((c for c in counts if ord(c) < 65536 and counts[c] >= 20), key=lambda c: (-counts[c], c))[:700]))
    table = symbol_table(own)
    stream, tags, marks = [], [], []
    place = 0
    for t, sp in zip(texts, spans):
        ids = np.append(symbols(t, table), [GAP] * GAPS)
        y = np.zeros(len(ids), np.int8)
        for a, b, k in sp:
            y[a] = 1 + 2 * k
            y[a + 1 : b] = 2 + 2 * k
            marks.append((place + a, k))
        stream.append(ids)
        tags.append(y)
        place += len(ids)
    x, y = np.concatenate(stream).astype(np.int64), np.concatenate(tags).astype(np.int64)
    by_kind = [np.array([a for a, k in marks if k == kind]) for kind in range(len(KINDS))]
    p = {k: v.astype(np.float32) for k, v in begin.items() if k != "own"} if begin else initial(first_own_symbol() + len(own), hidden, rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    fixed = allowed_transitions() <= -30
    began = time.time()
    _DATA.update(x=x, y=y, by_kind=by_kind)
    with get_context("fork").Pool(workers) as pool:
        for step in range(1, steps + 1):
            parts = pool.map(_sampled_gradients, [(p, (seed, step, w), rows, width) for w in range(workers)], chunksize=1)
            loss = sum(x[0] for x in parts) / workers
            g = {k: sum(x[1][k] for x in parts) / workers for k in p}
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            done = max(step / steps, (time.time() - began) / seconds)
            now = rate * min(1, step / 50) * max(0.02, 1 - done)
            for k, a in g.items():
                a *= min(1.0, 0.5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.995 * v[k] + 0.005 * a * a
                p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)
            p["T"][fixed] = -30
            if step % 100 == 0:
                print(f"step {step}, loss {loss:.5f}, {time.time() - began:.0f} s", flush=True)
            if time.time() - began > seconds:
                break
    return p | {"own": np.array(own)}


def thinned(weights: dict[str, np.ndarray], keep: int) -> dict[str, np.ndarray]:
    """The weights of the ``keep`` units of each direction that tell the tags and the other units most; to be trained on."""
    out = dict(weights)
    for d in "fb":
        U, V = (weights[f"{k}{d}"].astype(np.float32) for k in "UV")
        units = np.sort(np.argsort(-(np.abs(V).sum(axis=1) + 0.5 * np.abs(U).sum(axis=1)))[:keep])
        gates = np.concatenate([units + k * len(U) for k in range(3)])
        out |= {f"U{d}": weights[f"U{d}"][units][:, gates], f"V{d}": weights[f"V{d}"][units], f"E{d}": weights[f"E{d}"][:, gates], f"b{d}": weights[f"b{d}"][gates]}
    return out


def evaluate(weights: dict[str, np.ndarray], texts: list[str], spans: list[list[Span]]) -> dict[str, tuple[int, int, int]]:
    """Per kind: spans found exactly, spans found, spans labelled."""
    gold = {(k, *s) for k, sp in enumerate(spans) for s in sp}
    found = {(k, *s) for k, sp in enumerate(Tagger(weights).spans(texts)) for s in sp}
    return {name: (len({x for x in found & gold if x[3] == k}), len({x for x in found if x[3] == k}), len({x for x in gold if x[3] == k})) for k, name in enumerate(KINDS)}


def sampled(directory: str, sample: int) -> tuple[list[str], Marker]:
    """Distinct texts of the first ``sample`` documents by doc_id, shuffled, and the marker learnt from them."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{directory}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").slice(0, sample)["text"].to_pylist() if t]
    texts = list(dict.fromkeys(texts))
    random.Random(7).shuffle(texts)
    listed = [*pq.read_table(f"{directory}/story_figures.parquet")["figure_name"].to_pylist(), *pq.read_table(f"{directory}/entities_raw.parquet")["name"].to_pylist()]
    return texts, Marker(texts, {n.strip().lower() for n in listed if n})


def passages(texts: list[str], marks: list[list[Span]], make: Inventor, count: int) -> list[tuple[str, list[Span]]]:
    """Passages of invented sentences with spans between sentences without any of the texts."""
    fillers = [m.group().strip() for t, sp in zip(texts, marks) for m in re.finditer(r"[^.!?。！？।\n]{15,160}[.!?。！？।]", t) if not any(a < m.end() and m.start() < b for a, b, _ in sp)]
    return [make.passage(lambda: make.rng.choice(fillers)) for _ in range(count)]


def main(directory: str, sample: int = 10_000, seconds: float = 900, workers: int = 8, rate: float | None = None, units: int | None = None) -> None:
    texts, mark = sampled(directory, sample)
    held, kept = texts[: len(texts) // 10], texts[len(texts) // 10 :]
    rng = random.Random(7 if rate is None else 17)
    make = Inventor(rng)
    marks = [mark(t) for t in kept]
    training = [varied(t, sp, make, share) for share in (0.0, 0.0, 0.0, 0.5) for t, sp in zip(kept, marks)]
    training += passages(kept, marks, make, int(1.2 * len(kept)))
    rng.shuffle(training)
    print(len(training), "texts,", sum(len(s) for _, s in training), "spans", flush=True)
    begin = None if rate is None else dict(np.load(WEIGHTS))
    if units is not None:
        begin = thinned(begin, units)
    weights = train([t for t, _ in training], [s for _, s in training], seconds=seconds, steps=40_000, workers=workers, begin=begin, rate=rate or 0.01, seed=1 if rate is None else 2)
    np.savez_compressed(WEIGHTS, **{k: v if k == "own" else v.astype(np.float16) for k, v in weights.items()})
    held_marks = [mark(t) for t in held]
    print("held-out documents:", evaluate(weights, held, held_marks))
    invented = passages(held, held_marks, Inventor(random.Random(8), held=True), 2000)
    print("held-out names and forms:", evaluate(weights, [t for t, _ in invented], [s for _, s in invented]))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]), *map(float, sys.argv[3:4]), *map(int, sys.argv[4:5]), *map(float, sys.argv[5:6]), *map(int, sys.argv[6:7]))
