"""Plug points: embedders, summarizers and rerankers, with deterministic offline ones."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H

#: Characters of the texts that are embedded together, unless one text has more.
CHARACTERS = 1 << 17


class Embedder(Protocol):
    """Vectors for texts; runs inside Arrow batches, so it must pickle."""

    dimension: int
    identity: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...
    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs to unit vectors; needs no model."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.identity = dimension, f"hash/{dimension}"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out, at = [], 0
        while at < len(texts):
            last, size = at, 0
            while last < len(texts) and (last == at or size + len(texts[last] or "") <= CHARACTERS):
                size += len(texts[last] or "")
                last += 1
            out += self._embed([t or "" for t in texts[at:last]]).tolist()
            at = last
        return out

    def _embed(self, texts: list[str]) -> np.ndarray:
        buffer, starts, ends, text = H.words(texts)
        two = np.flatnonzero(text[1:] == text[:-1])  # a pair is a slice, from a word's start to the next word's end
        h = H.xxh64(buffer, np.concatenate([starts, starts[two]]), np.concatenate([ends, ends[two + 1]]))
        at = np.concatenate([text, text[two]]) * self.dimension + (h % np.uint64(self.dimension)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * self.dimension).reshape(len(texts), self.dimension)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return (v / np.where(norm, norm, 1.0)).astype(np.float32)

    def embed_query(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


def embed(text: Column, embedder: Embedder) -> Column:
    """Vector column of a text column; NULL for NULL."""

    @F.arrow_udf("array<float>")
    def of(col: pa.Array) -> pa.Array:
        texts = col.to_pylist()
        at = [i for i, t in enumerate(texts) if t is not None]
        made = dict(zip(at, embedder.embed_batch([texts[i] for i in at]), strict=True))
        return pa.array([made.get(i) for i in range(len(texts))], pa.list_(pa.float32()))

    return of(text)


def embed_cached(df: DataFrame, text: str, embedder: Embedder, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``vector``, the cache to keep): each distinct text is embedded once, texts of the cache not at all.

    The cache is a table (identity, hash, vector); equal 64-bit hashes of
    texts count as equal texts.
    """
    keyed = df.withColumn("__hash", F.xxhash64(text))
    known = cache.where(F.col("identity") == embedder.identity).select("hash", "vector") if cache is not None else df.sparkSession.createDataFrame([], "hash long, vector array<float>")
    fresh = keyed.join(known, F.col("__hash") == F.col("hash"), "left_anti").groupBy("__hash").agg(F.min(text).alias("t"))
    new = fresh.select(F.col("__hash").alias("hash"), embed(F.col("t"), embedder).alias("vector"))
    every = known.unionByName(new)
    out = keyed.join(every, F.col("__hash") == F.col("hash"), "left").drop("__hash", "hash")
    grown = new.select(F.lit(embedder.identity).alias("identity"), "hash", "vector")
    return out, grown if cache is None else cache.unionByName(grown)


def lead_summarizer(text: str, chars: int = 200) -> str:
    """The first sentences up to ``chars`` characters."""
    out = ""
    for part in text.replace("\n", " ").split(". "):
        if out and len(out) + len(part) > chars:
            break
        out += (". " if out else "") + part
    return out[:chars]


def summarize(text: Column, summarizer=lead_summarizer) -> Column:
    @F.arrow_udf("string")
    def of(col: pa.Array) -> pa.Array:
        return pa.array([None if t is None else summarizer(t) for t in col.to_pylist()], pa.string())

    return of(text)
