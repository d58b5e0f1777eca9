"""Embedding and model providers. Offline stand-ins are deterministic; they exercise the jobs and say nothing of quality."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def scores(self, question: str, texts: list[str]) -> list[float]: ...


class Model(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashedGrams:
    """Counts of hashed character trigrams, of length 1; zero for a blank text."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            t = t.strip()
            if t:
                grams = [zlib.crc32(t[j : j + 3].encode()) for j in range(max(1, len(t) - 2))]
                out[i] = np.bincount(np.array(grams) % self.size, minlength=self.size)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed_of(text: Column, embedder: Embedder | None = None) -> Column:
    embedder = embedder or HashedGrams()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(c: pa.Array) -> pa.Array:
        return pa.array(embedder.embed([t or "" for t in c.to_pylist()]).tolist(), pa.list_(pa.float64()))

    return run(text)
