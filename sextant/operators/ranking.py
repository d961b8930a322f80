"""Ranking: total order, decay, caps per value, diversity, rank fusion and reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.filters import millis

CAP_DEPTH, DIVERSITY_DEPTH, DIVERSITY_WINDOW = 8, 4, 512
#: Groups of a cap beyond this many are not capped.
CAP_GROUPS = 10_000


def order(score: str = "score") -> list[Column]:
    """Best first: NaN last, ties by collection and id."""
    return [F.isnan(score), F.desc(score), F.col("collection"), F.col("id")]


@dataclass(frozen=True)
class Decay:
    """score - weight * (1 - decay ** (age / scale)) - count_weight * (1 - n / (n + count_scale)).

    ``field`` holds a timestamp or epoch milliseconds; records without it have
    the factor ``missing``. Ages count from ``origin`` (ms) and are 0 in its future.
    """

    origin: int = 0
    field: str = ""
    scale: float = 7 * 86_400_000.0
    decay: float = 0.5
    weight: float = 1.0
    missing: float = 1.0
    count_field: str = ""
    count_scale: float = 10.0
    count_weight: float = 1.0

    def __post_init__(self):
        ok = self.scale > 0 and 0 < self.decay < 1 and 0 <= self.missing <= 1 and self.count_scale > 0
        ok = ok and all(math.isfinite(w) and w >= 0 for w in (self.weight, self.count_weight))
        if not ok or not (self.field or self.count_field):
            raise ValueError("bad decay parameters")

    def apply(self, score: Column, df: DataFrame) -> Column:
        if self.field:
            at = F.col(self.field)
            if isinstance(df.schema[self.field].dataType, (T.TimestampType, T.TimestampNTZType)):
                at = millis(at, df.schema[self.field].dataType)
            age = F.greatest(F.lit(self.origin) - at, F.lit(0)) / F.lit(float(self.scale))
            # greatest() passes NULLs over, so a missing time is asked for.
            factor = F.when(at.isNotNull(), F.pow(F.lit(float(self.decay)), age)).otherwise(float(self.missing))
            score = score - self.weight * (1 - factor)
        if self.count_field:
            n = F.greatest(F.coalesce(F.col(self.count_field).cast("double"), F.lit(0.0)), F.lit(0.0))
            score = score - self.count_weight * (1 - n / (n + self.count_scale))
        return score


def limit_per(hits: DataFrame, key: str, most: int, sort: list[Column]) -> DataFrame:
    """At most ``most`` hits for each value of ``key``, in rank order; records without it are one group."""
    if most < 1:
        raise ValueError("a cap is at least 1")
    window = Window.partitionBy(F.col(key)).orderBy(*sort)
    return hits.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= most).drop("__rn")


def mmr_order(score: np.ndarray, vectors: list, lam: float) -> list[int]:
    """Greedy maximal marginal relevance over ranked rows: places in the new order.

    Takes the row of greatest lam * score - (1 - lam) * (largest cosine to a
    taken row, at least 0); the first in rank wins ties; rows without a vector
    are never penalised.
    """
    n = len(score)
    dim = next((len(v) for v in vectors if v is not None), 0)
    m = V.unit(np.array([v if v is not None else [0.0] * dim for v in vectors], float).reshape(n, dim))
    norms = np.linalg.norm(m, axis=1)
    m[norms <= V.TINY] = 0.0
    near, left, out = np.zeros(n), np.ones(n, bool), []
    for _ in range(n):
        worth = np.where(left, lam * score - (1 - lam) * near, -np.inf)
        best = int(np.argmax(worth)) if not np.isnan(worth).all() else int(np.argmax(left))
        out.append(best)
        left[best] = False
        near = np.maximum(near, np.nan_to_num(m @ m[best]))
    return out


def diversify(hits: DataFrame, lam: float, sort: list[Column], keys: list[str] = ()) -> DataFrame:
    """``hits`` with ``rank`` (from 0) in maximal-marginal-relevance order, for each value of ``keys``.

    The first 512 hits are reordered, the rest keep their places. ``hits`` is a
    ranked page, some thousands of rows for each key at most.
    """
    if not 0 <= lam <= 1:
        raise ValueError("lambda is from 0 to 1")
    window = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*sort) if keys else Window.partitionBy(F.lit(0)).orderBy(*sort)
    ranked = hits.withColumn("rank", (F.row_number().over(window) - 1).cast("long"))
    schema = ranked.schema

    def reorder(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        head = part.head(DIVERSITY_WINDOW)
        if len(head) > 1:
            places = mmr_order(head["score"].to_numpy(float), list(head["vector"]), lam)
            rank = part["rank"].to_numpy().copy()
            rank[places] = np.arange(len(places))
            part["rank"] = rank
        return part

    return ranked.groupBy(*keys).applyInPandas(reorder, schema) if keys else ranked.groupBy(F.lit(0).alias("__k")).applyInPandas(reorder, schema)


def fuse(legs: list[DataFrame], weights: list[float] | None = None, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: score = sum of weight / (k + rank + 1) over legs (collection, id, rank from 0, ...).

    Other columns come from the first leg that has the record; ``legs`` lists
    (leg, rank, score) of each that does.
    """
    weights = weights or [1.0] * len(legs)
    if len(weights) != len(legs) or not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("one finite weight of 0 or more per leg")
    rest = [c for c in legs[0].columns if c not in ("collection", "id", "rank", "score")]
    parts = [leg.select("collection", "id", F.lit(i).alias("leg"), "rank", "score", F.lit(float(w)).alias("w"), F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest")) for i, (leg, w) in enumerate(zip(legs, weights, strict=True))]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("collection", "id").agg(
        F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score"),
        F.min_by("rest", "leg").alias("rest"),
        F.array_sort(F.collect_list(F.struct("leg", "rank", "score"))).alias("legs"),
    )
    return out.select("collection", "id", "score", "legs", *([f"rest.{c}" for c in rest]))


Reranker = Callable[[str, list[str]], list[float]]


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """An offline reranker: the share of query tokens in each text, with a small bonus for density."""
    from ..functions.text import token_list

    q = set(token_list(query))
    out = []
    for t in texts:
        words = token_list(t or "")
        hit = sum(w in q for w in words)
        out.append(len(q & set(words)) / max(1, len(q)) + 0.1 * hit / max(1, len(words)))
    return out


def rerank(page: DataFrame, query: str, text_column: str, reranker: Reranker = overlap_reranker) -> DataFrame:
    """Scores of ``page`` replaced by the reranker's for (query, text); records without text keep theirs, after all others.

    ``page`` is a ranked window, so it is bounded; the text goes through Arrow in batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = b[text_column].notna() & (b[text_column] != "")
            new = b["score"].astype(float).copy()
            if has.any():
                new[has] = reranker(query, b.loc[has, text_column].tolist())
            yield b.assign(score=new, passed=~has)

    schema = T.StructType([*page.schema.fields, T.StructField("passed", T.BooleanType())])
    return page.mapInPandas(run, schema)


def rerank_order() -> list[Column]:
    return [F.col("passed"), *order()]
