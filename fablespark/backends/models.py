"""Model backends: protocols for text generation and embedding, deterministic defaults, HTTP clients, a registry by name."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol
from urllib.request import Request, urlopen

import numpy as np

from fablespark.operators.chunking import count_words, hashed_embedding


class TextModel(Protocol):
    """Answers a prompt with text; made anew in every task by its factory."""

    def __call__(self, prompt: str) -> str: ...


class EmbeddingModel(Protocol):
    """Vectors and token counts of texts."""

    def embed(self, texts: list[str], kind: str = "raw") -> np.ndarray: ...
    def token_count(self, text: str) -> int: ...
    def check(self) -> bool: ...


class HashedEmbedding:
    """Word-count vectors under a fixed hash, unit length; ``prefixes`` are put before the texts by their kind."""

    def __init__(self, size: int = 64, max_tokens: int = 512, prefixes: dict[str, str] | None = None, batch: int = 32):
        self.size, self.max_tokens, self.prefixes, self.batch = size, max_tokens, prefixes or {}, batch

    def embed(self, texts: list[str], kind: str = "raw") -> np.ndarray:
        texts = [self.prefixes.get(kind, "") + t for t in texts]
        if any(self.token_count(t) >= self.max_tokens for t in texts):
            raise ValueError(f"a text has {self.max_tokens} tokens or more")
        return np.concatenate([hashed_embedding(texts[k : k + self.batch], self.size) for k in range(0, len(texts), self.batch)]) if texts else np.zeros((0, self.size))

    def token_count(self, text: str) -> int:
        return count_words(text)

    def check(self) -> bool:
        return True


class HttpEmbedding:
    """An embedding service: one POST per batch of texts."""

    def __init__(self, url: str, model: str, prefixes: dict[str, str] | None = None, batch: int = 32, timeout: float = 300):
        self.url, self.model, self.prefixes, self.batch, self.timeout = url.rstrip("/"), model, prefixes or {}, batch, timeout

    def embed(self, texts: list[str], kind: str = "raw") -> np.ndarray:
        found: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            part = [self.prefixes.get(kind, "") + t for t in texts[k : k + self.batch]]
            request = Request(f"{self.url}/api/embed", json.dumps({"model": self.model, "input": part}).encode(), {"Content-Type": "application/json"})
            with urlopen(request, timeout=self.timeout) as answer:
                found += json.load(answer)["embeddings"]
        return np.array(found)

    def token_count(self, text: str) -> int:
        return count_words(text)

    def check(self, timeout: float = 5) -> bool:
        return HttpModel(self.url, self.model).check(timeout)


class SentenceEmbedding:
    """A local sentence encoder, where its package is installed."""

    def __init__(self, model: str, prefixes: dict[str, str] | None = None, batch: int = 32):
        from sentence_transformers import SentenceTransformer

        self.model, self.prefixes, self.batch = SentenceTransformer(model), prefixes or {}, batch

    def embed(self, texts: list[str], kind: str = "raw") -> np.ndarray:
        return np.asarray(self.model.encode([self.prefixes.get(kind, "") + t for t in texts], batch_size=self.batch))

    def token_count(self, text: str) -> int:
        return len(self.model.tokenizer.tokenize(text))

    def check(self) -> bool:
        return True


class Cached:
    """A text model that remembers its last answers within a task; equal prompts are asked once."""

    def __init__(self, model: TextModel, most: int = 10_000):
        self.ask = lru_cache(most)(model)

    def __call__(self, prompt: str) -> str:
        return self.ask(prompt)


class HttpModel:
    """A generation service: one POST per prompt, not streamed."""

    def __init__(self, url: str, model: str, temperature: float = 0.1, max_tokens: int = 32768, max_prompt: int = 100_000, timeout: float = 1800):
        self.url, self.timeout, self.max_prompt = url.rstrip("/"), timeout, max_prompt
        self.body = {"model": model, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}

    def __call__(self, prompt: str) -> str:
        if len(prompt) > self.max_prompt:
            raise ValueError("the prompt is too long")
        request = Request(f"{self.url}/api/generate", json.dumps(self.body | {"prompt": prompt}).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["response"]

    def check(self, timeout: float = 5) -> bool:
        """Whether the service answers."""
        try:
            with urlopen(f"{self.url}/api/tags", timeout=timeout) as answer:
                return answer.status == 200
        except OSError:
            return False


_NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b")


def rule_based_extractor(prompt: str) -> str:
    """Entities of a prompt's text by capitals: a test double of a model, used where none is given. The answer is JSON, like a model's."""
    text = prompt.rpartition("TEXT:")[2]
    names = dict.fromkeys(_NAME.findall(text))
    places = {m.group(1) for m in re.finditer(r"\b(?:in|near|from|of|at|to) ([A-Z][a-z]+)\b", text)}
    rows = [{"entity_type": "character", "name": n, "description": f"Named {text.count(n)} times.", "aliases": [n.split()[0]]} for n in names]
    rows += [{"entity_type": "location", "name": p, "description": "A place.", "aliases": []} for p in sorted(places)]
    return json.dumps({"entities": rows}, ensure_ascii=False)


def rule_based_statistics(prompt: str) -> str:
    """Mentions, dialogues and actions of the named character in a text, by counting."""
    name = re.search(r"CHARACTER: (.*)", prompt)
    text, who = prompt.rpartition("TEXT:")[2], (name.group(1).strip() if name else "")
    n = text.count(who) if who else 0
    said = len(re.findall(rf"(?:said|called|asked|replied|wrote) {re.escape(who)}\b|\b{re.escape(who)} (?:said|called|asked|replied|wrote)", text)) if who else 0
    return json.dumps({"mentions_by_others": n, "dialogues": said, "actions": max(0, n - said), "new_aliases": []})


def rule_based_structure(prompt: str) -> str:
    """The entities of a structuring prompt with their longest description; a test double of a model, with its form of answer."""
    items = json.loads(prompt.partition("\n")[2])
    rows = [{**e, "description": max(e.get("description") or [""], key=len), "aliases": sorted(set(e.get("aliases") or []))} for e in items]
    return json.dumps({"entities": rows}, ensure_ascii=False)


def same_scene_rule(prompt: str) -> str:
    """YES if the chunks of a prompt share two words of five letters or more."""
    parts = [set(re.findall(r"\w{5,}", p.lower())) for p in prompt.split("CHUNK")[1:]]
    return "YES" if len(parts) < 2 or len(parts[0] & parts[1]) >= 2 else "NO"


REGISTRY: dict[str, Callable] = {"hashed": HashedEmbedding, "http embedding": HttpEmbedding, "sentence": SentenceEmbedding, "http": HttpModel, "rules": lambda: rule_based_extractor, "rule statistics": lambda: rule_based_statistics, "rule structure": lambda: rule_based_structure, "same scene": lambda: same_scene_rule}


def create(name: str, **parameters):
    """A backend by name."""
    if name not in REGISTRY:
        raise ValueError(f"unknown backend {name}; known are {sorted(REGISTRY)}")
    return REGISTRY[name](**parameters)
