"""Approximate search: quantised first passes, an inverted-file index, and tuning against exact search.

All follow one contract: candidates may be approximate, the final order is by
exact scores, and where a filter leaves few records these are scored exactly.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.filters import bind, compile_filter
from ..functions.partitions import materialize
from . import ranking as R
from . import search as S

#: Default depths of first passes, in multiples of the page.
INT8_RESCORE, BINARY_RESCORE, OVERSCAN, PROBES = 4, 16, 4, 8
ITERATIONS = 12
#: Vectors that centroids are fitted on at most; every record is indexed.
FIT_ROWS = 50_000
#: Vectors that are held against all centroids at a time; records of a list that one task holds, about.
FIT_BLOCK, PART = 2048, 20_000
#: Queries that meet a list's records at a time.
QUERY_STEP = 2048


def add_int8(df: DataFrame, scale: float | None = None, metric: str = "cosine") -> tuple[DataFrame, float]:
    """``df`` with int8 ``codes`` of the vectors (of unit length for cosine) at one symmetric scale, the greatest magnitude / 127."""
    if scale is None:
        top = df.where("vector is not null").select(V.peak(F.col("vector"), metric).alias("m")).agg(F.max("m")).first()[0]
        scale = (top or 1.0) / 127
    return df.withColumn("codes", V.int8_codes(F.col("vector"), scale, metric)), scale


def add_signs(df: DataFrame, dimension: int) -> DataFrame:
    return df.withColumn("signs", V.sign_words(F.col("vector"), dimension))


def _exact(candidates: DataFrame, query: list[float], opts: S.SearchOptions, metric: str) -> DataFrame:
    return S.tail(candidates.drop("score", "codes", "signs", "list_id").withColumn("score", V.score(F.col("vector"), list(query), metric)), opts)


def search_int8(df: DataFrame, query: list[float], scale: float, opts: S.SearchOptions = S.SearchOptions(), metric: str = "cosine", rescore: int = INT8_RESCORE) -> DataFrame:
    """Two passes: the best depth x ``rescore`` by codes, then exact scores. ``df`` has the column ``codes``.

    Where the codes are of unit vectors and the page is cut by score alone, the
    first pass is only a start: no vector that codes could hide is left out, since a code is
    off by half a ``scale`` in each element at most. The score of the page's
    last row among the first candidates, less that error, is what a code has to reach.
    """
    q = V.unit(np.array([query], float))[0] if metric == "cosine" else np.array(query, float)
    codes = V.quantize(q, scale)
    rows = S.scoped(df, opts.scope).where(compile_filter(opts.where, bind(df))).where("codes is not null")
    first = rows.withColumn("score", V.score(F.col("codes"), codes.tolist(), "dot" if metric == "cosine" else metric))
    candidates = first.orderBy(*R.order()).limit(opts.depth * rescore)
    if metric == "cosine" and opts.rank_by is None and opts.depth > 0:
        known = candidates.select(V.score(F.col("vector"), list(query), metric).alias("s")).orderBy(F.isnan("s"), F.desc("s")).limit(opts.depth).agg(F.min("s"), F.count(F.lit(1))).first()
        # Fewer candidates than a page are all there are.
        if known[1] == opts.depth and math.isfinite(known[0]):
            error = scale / 2 * float(np.abs(q).sum()) + (1 + scale / 2 * math.sqrt(len(q))) * float(np.linalg.norm(q - scale * codes)) + 1e-6
            candidates = first.where((F.col("score") * scale * scale >= known[0] - error) | F.isnan("score"))
    return _exact(candidates, query, opts, metric)


def search_binary(df: DataFrame, query: list[float], opts: S.SearchOptions = S.SearchOptions(), rescore: int = BINARY_RESCORE) -> DataFrame:
    """Two passes: the nearest depth x ``rescore`` by Hamming distance of sign bits, then exact cosine. ``df`` has ``signs``."""
    bits = np.array(query) >= 0
    words = [int(sum(1 << i for i, b in enumerate(bits[at : at + 64]) if b)) for at in range(0, len(bits), 64)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    rows = S.scoped(df, opts.scope).where(compile_filter(opts.where, bind(df))).where("signs is not null")
    first = rows.withColumn("score", -V.hamming(F.col("signs"), F.array(*[F.lit(w).cast("long") for w in words])).cast("double"))
    return _exact(first.orderBy(*R.order()).limit(opts.depth * rescore), query, opts, "cosine")


@dataclass
class Ivf:
    """Centroids of an inverted-file index; records carry the number of their list in ``list_id``."""

    centroids: np.ndarray
    metric: str

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with ``list_id``: the centroid of the greatest score, the first of equals; NULL without a vector. New records are assigned the same way, without a new fit."""
        centroids, metric = self.centroids, self.metric

        @F.arrow_udf("int")
        def of(col: pa.Array) -> pa.Array:
            m, known = V.matrix(col)
            at = np.concatenate([V.scores(m[i : i + S.STEP], centroids, metric).argmax(axis=1) for i in range(0, len(m), S.STEP)]) if len(m) and m.shape[1] else np.zeros(len(m), int)
            return pa.array(at.astype(np.int32), mask=~known)

        return df.withColumn("list_id", of("vector"))

    def probes(self, query: list[float], n: int) -> list[int]:
        s = V.scores(self.centroids, np.array([query], float), self.metric)[:, 0]
        return [int(i) for i in np.argsort(-s, kind="stable")[:n]]


def fit_ivf(df: DataFrame, metric: str = "cosine", lists: int | None = None, fit_rows: int = FIT_ROWS) -> Ivf:
    """Lloyd's iterations from distinct records, on at most ``fit_rows`` vectors (a hash picks them); lists default to the root of the number of records."""
    rows = df.where("vector is not null")
    n = rows.count()
    k = lists or max(1, round(math.sqrt(n)))
    picked = rows.orderBy(F.xxhash64("collection", "id")).limit(fit_rows).select("vector").toArrow()["vector"]
    m, _ = V.matrix(picked)
    m = V.unit(m) if metric == "cosine" else m
    c = np.unique(m, axis=0)
    c = m[np.sort(np.unique(m, axis=0, return_index=True)[1])[: min(k, len(c))]].copy()
    last = None
    for _ in range(ITERATIONS):
        at = np.concatenate([V.scores(m[i : i + FIT_BLOCK], c, metric).argmax(axis=1) for i in range(0, len(m), FIT_BLOCK)]) if len(m) else np.zeros(0, int)
        if last is not None and (at == last).all():
            break
        last = at
        sums, counts = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, m)
        full = counts > 0  # an empty centroid stays
        c[full] = sums[full] / counts[full, None]
        c = V.unit(c) if metric == "cosine" else c
    return Ivf(c, metric)


def save_ivf(indexed: DataFrame, path: str) -> None:
    """Store assigned records by list, so that a search reads its lists' folders only."""
    indexed.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def search_ivf(df: DataFrame, index: Ivf, query: list[float], opts: S.SearchOptions = S.SearchOptions(), probes: int = PROBES, overscan: int = OVERSCAN, exact: bool = False, scale: float | None = None) -> DataFrame:
    """Search the nearest ``probes`` lists of ``df`` (which has ``list_id``).

    Records that no list holds yet are always scanned. Everything is scored
    exactly where ``exact``, or where the filter leaves few records. With
    ``scale``, and the column ``codes``, int8 codes choose the candidates in the lists.
    """
    if not exact and (opts.where is not None or opts.scope is not None):
        rows = S.scoped(df, opts.scope).where(compile_filter(opts.where, bind(df))).where("vector is not null")
        enough = opts.depth * overscan
        few = max(df.count() // overscan, enough)
        exact = rows.limit(few + 1).count() <= few
    chosen = df if exact else df.where(F.col("list_id").isin(index.probes(query, probes)) | F.col("list_id").isNull())
    if scale is not None and not exact:
        return search_int8(chosen.drop("list_id"), query, scale, opts, index.metric)
    return S.search(chosen.drop("list_id", "codes", "signs"), query, opts, index.metric)


def search_hnsw(df: DataFrame, index: Ivf, query: list[float], opts: S.SearchOptions = S.SearchOptions(), ef_search: int = 64) -> DataFrame:
    """The contract of a graph index, met by the inverted file at wider probes (a graph walk does not distribute)."""
    return search_ivf(df, index, query, opts, probes=max(PROBES, ef_search // 2))


def _top(scored: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query").orderBy(*R.order())
    return scored.withColumn("rank", (F.row_number().over(window) - 1).cast("long")).where(F.col("rank") < k)


def search_ivf_batch(indexed: DataFrame, index: Ivf, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """(query, collection, id, score, rank): ``search_ivf`` for a table of queries (query, vector) of any size.

    Queries are dealt to the lists they probe and meet each list's records
    there; long lists are parted, so no list is one task's alone. Records that
    no list holds yet are searched by all queries.
    """
    centroids, metric = index.centroids, index.metric

    @F.arrow_udf("array<int>")
    def nearest(col: pa.Array) -> pa.Array:
        m, _ = V.matrix(col)
        near = [np.argsort(-V.scores(m[i : i + S.STEP], centroids, metric), axis=1, kind="stable")[:, :probes].astype(np.int32) for i in range(0, len(m), S.STEP)]
        return pa.array([x for some in near for x in some], pa.list_(pa.int32()))

    records = indexed.where("vector is not null").select("list_id", "collection", "id", "vector")
    lists = materialize(records.where("list_id is not null").groupBy("list_id").agg((F.floor(F.count(F.lit(1)) / PART) + 1).cast("int").alias("parts")))
    asked = materialize(queries.where("vector is not null").select(F.col("query").cast("string").alias("query"), "vector"))
    left = records.join(lists, "list_id").withColumn("part", F.pmod(F.xxhash64("collection", "id"), F.col("parts")).cast("int"))
    probed = asked.select("query", F.col("vector").alias("qv"), F.explode(nearest("vector")).alias("list_id")).join(lists, "list_id")
    # A list that very many queries probe meets them in parts too, its records once for each.
    crowds = materialize(probed.groupBy("list_id").agg((F.floor(F.count(F.lit(1)) / PART) + 1).cast("int").alias("crowds")))
    left = left.join(crowds, "list_id").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
    probed = probed.join(crowds, "list_id").withColumn("crowd", F.pmod(F.xxhash64("query"), F.col("crowds")).cast("int"))
    right = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = T.StructType([T.StructField("query", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])

    def meet(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            return to_arrow_schema(out).empty_table()
        got = []
        colls, ids = rows["collection"].combine_chunks(), rows["id"].combine_chunks()
        for at in range(0, len(wanted), QUERY_STEP):
            some = wanted.slice(at, QUERY_STEP)
            q, best = V.matrix(some["qv"])[0], S.Best(len(some), k)
            for row in range(0, len(rows), S.STEP):
                m, known = V.matrix(rows["vector"].slice(row, S.STEP))
                best.add(V.scores(m, q, metric), colls.slice(row, S.STEP), ids.slice(row, S.STEP), known)
            names = some["query"].combine_chunks()
            got += [pa.table({"query": names.take(pa.array(of)), "collection": c, "id": i, "score": s}).cast(to_arrow_schema(out)) for of, c, i, s in best.parts()]
        return pa.concat_tables(got)

    keys = ["list_id", "part", "crowd"]
    found = left.select(*keys, "collection", "id", "vector").groupBy(*keys).cogroup(right.select(*keys, "query", "qv").groupBy(*keys)).applyInArrow(meet, out)
    loose = records.where("list_id is null")
    if loose.take(1):
        found = found.unionByName(S.top_k_blocks(loose, asked, k, metric).drop("rank"))
    return _top(found, k)


def search_codes_batch(df: DataFrame, queries: DataFrame, k: int, kind: str = "int8", rescore: int | None = None, metric: str = "cosine") -> DataFrame:
    """(query, collection, id, score, rank): two passes for a table of queries (query, vector) of any size.

    The first pass ranks by int8 codes or by sign bits (``kind`` "binary", whose
    Hamming distance is a product of signs) and keeps ``rescore`` x k a query, the second scores those exactly.
    """
    depth = k * (rescore or (INT8_RESCORE if kind == "int8" else BINARY_RESCORE))
    asked = materialize(queries.where("vector is not null").select(F.col("query").cast("string").alias("query"), "vector"))
    if kind == "int8":
        _, scale = add_int8(df, metric=metric)

        def coded(c):
            return V.int8_codes(c, scale, metric)
    else:

        def coded(c):
            return F.transform(c, lambda x: F.when(x >= 0, 1).otherwise(-1).cast("tinyint"))

    first = S.top_k_blocks(df.where("vector is not null").select("collection", "id", coded(F.col("vector")).alias("vector")), asked.select("query", coded(F.col("vector")).alias("vector")), depth, "dot" if kind == "binary" or metric == "cosine" else metric)
    pairs = first.select("query", "collection", "id").join(df.select("collection", "id", "vector"), ["collection", "id"]).join(asked.withColumnRenamed("vector", "qv"), "query")

    @F.arrow_udf("double")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = V.matrix(a)[0], V.matrix(b)[0]
        if metric == "cosine":
            x, y = V.unit(x), V.unit(y)
        return pa.array(-((x - y) ** 2).sum(axis=1) if metric == "euclidean" else (x * y).sum(axis=1))

    return _top(pairs.select("query", "collection", "id", exact("vector", "qv").alias("score")), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true hits that were found, over (query, collection, id)."""
    got = recall_by_query(found, truth).agg(F.sum("found"), F.sum("n")).first()
    return got[0] / got[1] if got[1] else 1.0


def recall_by_query(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, n, found): how many true hits each query has, and how many of them were found."""
    keys = ["query", "collection", "id"]
    both = truth.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    return both.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"))


def choose_probes(indexed: DataFrame, index: Ivf, k: int = 10, target: float = 0.95, samples: int = 64) -> int:
    """The fewest probes, doubling, at which sampled stored vectors (a hash picks them) have a recall of ``target``."""
    picked = indexed.where("vector is not null").orderBy(F.xxhash64("id", "collection"), "id").limit(samples)
    queries = materialize(picked.select(F.concat_ws("/", "collection", "id").alias("query"), "vector"))
    truth = materialize(S.top_k_blocks(indexed.drop("list_id"), queries, k, index.metric))
    probes = 1
    while probes < len(index.centroids) and recall(search_ivf_batch(indexed, index, queries, k, probes), truth) < target:
        probes *= 2
    return min(probes, len(index.centroids))


def tune(df: DataFrame, metric: str = "cosine", samples: int = 20, top_k: int = 10, target: float = 0.95, probes: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> list[dict]:
    """Sweep the probes over sampled stored vectors: recall@k and latency of each cell, the fastest that meets the target ``recommended``.

    Records that were sampled don't count as hits of themselves.
    """
    index = fit_ivf(df, metric)
    indexed = index.assign(df).cache()
    picked = indexed.where("vector is not null").orderBy(F.xxhash64("id", "collection")).limit(samples).select("collection", "id", "vector").collect()
    out = []
    opts = S.SearchOptions(top_k=top_k + 1)
    wanted = {}
    for r in picked:
        hits = S.search(indexed.drop("list_id"), list(r["vector"]), opts, metric).orderBy("rank").collect()
        wanted[r["collection"], r["id"]] = {(h["collection"], h["id"]) for h in hits if (h["collection"], h["id"]) != (r["collection"], r["id"])}
    for p in probes:
        if p > 1 and p >= 2 * len(index.centroids):
            break
        took, right, all_ = [], 0, 0
        for r in picked:
            t = time.perf_counter()
            hits = search_ivf(indexed, index, list(r["vector"]), opts, p).orderBy("rank").collect()
            took.append(1000 * (time.perf_counter() - t))
            want = wanted[r["collection"], r["id"]]
            right += len(want & {(h["collection"], h["id"]) for h in hits})
            all_ += len(want)
        out.append({"probes": p, "recall": right / max(1, all_), "p50_ms": float(np.percentile(took, 50)), "p95_ms": float(np.percentile(took, 95)), "recommended": False})
    indexed.unpersist()
    good = [c for c in out if c["recall"] >= target]
    if good:
        best = min(good, key=lambda c: c["p50_ms"])
        best["recommended"] = True
    return out

