"""The seams for models: embedders and summary generators as plain callables, batched by Arrow."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def embedder_udf(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function from text to vector; load() runs once per worker, its result per batch."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(["" if t is None else t for t in texts])))

    return embed


def hashing_model(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence model: signed hashing of words, unit length."""

    def one(text: str) -> np.ndarray:
        v = np.zeros(dim, np.float32)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    return lambda texts: np.stack([one(t) for t in texts]) if texts else np.zeros((0, dim), np.float32)


def summary_udf(generate: Callable[[str], str]):
    """A column function from prompt to summary; a generator's failure is null, and the row stays.

    Prompts go to the worker some hundred at a time, not in Arrow batches of thousands of
    texts, so its memory stays that of a few of them.
    """

    def safe(prompt):
        try:
            return generate(prompt) if prompt is not None else None
        except Exception:  # one prompt's failure is its own row's
            return None

    return F.udf(safe, "string", useArrow=False)
