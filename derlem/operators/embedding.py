"""Embedding providers and re-rankers as what they promise, and their use on columns in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """What turns texts into vectors: a name, a length and a function over many texts; ``query`` and ``document`` may put their own words in front."""

    id: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashProvider:
    """Vectors without a model: words at weight 1.5 and the trigrams of words of five letters and more at 0.35, hashed to signed axes."""

    def __init__(self, dimensions: int = 128) -> None:
        self.id, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W]+", (t or "").translate(str.maketrans("İI", "iı")).lower()):
                parts = [(w, 1.5), *((w[i : i + 3], 0.35) for i in range(len(w) - 2) if len(w) >= 5)]
                for p, x in parts:
                    h = hashlib.sha256(p.encode()).hexdigest()
                    row[int(h[:7], 16) % self.dimensions] += x if int(h[7], 16) % 2 == 0 else -x
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, keys: list[str], text: str, provider: Provider) -> DataFrame:
    """(keys, provider_id, dim, vector, norm, content_hash) of texts that are not blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = provider.embed(b[text].tolist())
            yield b[[*keys, "content_hash"]].assign(vector=[x.astype(np.float32) for x in v], norm=np.linalg.norm(v, axis=1))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    own = df.filter(F.length(F.trim(text)) > 0).select(*keys, text, F.sha2(F.encode(text, "utf-8"), 256).alias("content_hash"))
    out = own.mapInPandas(run, f"{kinds}, content_hash string, vector array<float>, norm double")
    return out.select(*keys, F.lit(provider.id).alias("provider_id"), F.lit(provider.dimensions).alias("dim"), "vector", "norm", "content_hash")


def embed_changed(df: DataFrame, keys: list[str], text: str, stored: DataFrame, provider: Provider) -> DataFrame:
    """Vectors of the texts whose hash differs from the stored one, or that have none; the others are left alone."""
    have = stored.filter(F.col("provider_id") == provider.id).select(*keys, F.col("content_hash").alias("_h")).distinct()
    new = df.withColumn("_h", F.sha2(F.encode(F.col(text), "utf-8"), 256)).join(have, [*keys, "_h"], "left_anti").drop("_h")
    return embed(new, keys, text, provider)


def rerank(df: DataFrame, query: str, text: str, score: Callable[[str, list[str]], list[float]] | None) -> DataFrame:
    """``df`` with ``rerank_score`` by a model of query and text; without a model the ``score`` there is passes through."""
    if score is None:
        return df.withColumn("rerank_score", F.col("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(rerank_score=np.asarray(score(query, b[text].tolist()), dtype=float))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, rerank_score double")
