"""Plug-in protocols with offline defaults: embedding, generation and counting, each a vectorised function.

A plug-in is a function from texts to values; ``embed`` and ``generate`` wrap it so that what it loads is loaded once a worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str]], list[str]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Words and word pairs hashed into ``dims`` signed columns: deterministic and offline."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", text.lower())
            for item in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
                h = zlib.crc32(item.encode())
                row[h % dims] += 1 if h & 0x80000000 else -1
        return out

    return run


def embed(text: Column, load: Callable[[], Embedder], prefix: str = "", batch: int = 32) -> Column:
    """Vectors of length one (zero for a text without words); ``prefix`` tells queries from passages."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            parts = [model([prefix + t for t in texts.iloc[k : k + batch].fillna("")]) for k in range(0, len(texts), batch)]
            m = np.concatenate(parts) if parts else np.zeros((0, 1))
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            yield pd.Series(list((m / np.where(norms > 0, norms, 1)).astype(np.float32)), dtype=object)

    return run(text)


def generate(prompt: Column, load: Callable[[], Generator]) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(prompts.fillna("").tolist()), dtype=object)

    return run(prompt)


def extractive_generator() -> Generator:
    """Answers with the first sentence of the first excerpt, quoted and cited: what a generator that invents nothing would say."""
    import json

    def run(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = re.search(r"\[S(\d+)\][^\n]*\n(.+)", p)
            quote = re.split(r"(?<=[.!?])\s", m[2].strip())[0] if m else ""
            out.append(json.dumps({"answer": f"{quote} [S{m[1]}]" if m else "", "citations": [{"source_id": int(m[1]), "quote": quote}] if m else []}))
        return out

    return run
