"""Embeddings: a deterministic hashing model, and a cache that embeds each distinct text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that carry no direction.
STOP = set(
    "the a an and or of in to for is are was were be been being this that these those with as by on at it its from but if then than so "
    "such do does did have has had will would could should".split()
)
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


def hashing(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Counts of words by hash slot, of length one; the zero vector stays."""
    if dim < 8:
        raise ValueError("dim must be 8 or more")
    slots: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        import re

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                if len(w) > 1 and w not in STOP:
                    if w not in slots:
                        slots[w] = fnv1a(w.encode()) % dim
                    out[i, slots[w]] += 1
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)

    return embed


def embed(rows: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", out: str = "embedding") -> DataFrame:
    """``rows`` with the model's vectors; each distinct text is embedded once and joined back.

    ``model`` makes the embedder and runs once in each task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for x in frames:
            x[out] = list(f(x["_text"].tolist())) if len(x) else []
            yield x

    once = rows.select(F.col(text).alias("_text")).where("_text is not null").distinct().mapInPandas(run, f"_text string, {out} array<double>")
    return rows.join(once, F.col(text) == F.col("_text"), "left").drop("_text")
