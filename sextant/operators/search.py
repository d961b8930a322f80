"""Exact nearest-neighbour search and the tail that all ranked results share.

A search is one lazy plan: scope and filter (pushed down to the scan), score,
top-k by the total order (score descending with NaN last, collection, id). The
tail then caps per value, diversifies, cuts the page and expands neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.filters import Predicate, bind, compile_filter
from ..functions.partitions import materialize
from . import ranking as R

MAX_DEPTH, MAX_BATCH = 10_000, 16
#: Pages that a reranker scores.
OVERSCAN = 10
#: Query vectors that are searched in one pass, about.
QUERY_BLOCK = 2048
#: Records that are scored against a block of queries at a time.
STEP = 512


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    offset: int = 0
    where: Predicate | None = None
    scope: list[str] | None = None
    min_score: float | None = None
    rank_by: R.Decay | None = None
    limit_per: tuple[str, int] | None = None
    diversity: float | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None

    def __post_init__(self):
        if self.top_k < 0 or self.offset < 0 or self.offset + self.top_k > MAX_DEPTH:
            raise ValueError(f"a page ends at {MAX_DEPTH} at most")
        if self.include is not None and self.exclude is not None:
            raise ValueError("either include or exclude")

    @property
    def depth(self) -> int:
        """How deep to rank so that the tail has enough left."""
        page = self.offset + self.top_k
        return page * max(R.CAP_DEPTH if self.limit_per else 1, R.DIVERSITY_DEPTH if self.diversity is not None else 1)


def scoped(df: DataFrame, scope: list[str] | None) -> DataFrame:
    return df if scope is None else df.where(F.col("collection").isin(scope))


def project(hits: DataFrame, opts: SearchOptions) -> DataFrame:
    """The page's columns: never the vector; the attributes that are included, or not excluded."""
    own = [c for c in ("collection", "id", "score", "rank", "context") if c in hits.columns]
    attrs = [c for c in hits.columns if c not in (*own, "vector", "row")]
    if opts.include is not None:
        attrs = [c for c in attrs if c in opts.include]
    if opts.exclude is not None:
        attrs = [c for c in attrs if c not in opts.exclude]
    return hits.select(*own, *attrs)


def tail(scored: DataFrame, opts: SearchOptions) -> DataFrame:
    """From scored rows to a page with ``rank`` (from 0, counted over the whole ranking)."""
    if opts.rank_by is not None:
        scored = scored.withColumn("score", opts.rank_by.apply(F.col("score"), scored))
    if opts.min_score is not None:
        scored = scored.where(~(F.col("score") < opts.min_score))
    hits = scored.orderBy(*R.order()).limit(opts.depth)
    if opts.limit_per is not None:
        hits = R.limit_per(hits, *opts.limit_per, R.order())
    if opts.diversity is not None:
        hits = R.diversify(hits, opts.diversity, R.order())
    else:
        hits = hits.withColumn("rank", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*R.order())) - 1).cast("long"))
    page = hits.where((F.col("rank") >= opts.offset) & (F.col("rank") < opts.offset + opts.top_k))
    return project(page, opts)


def search(df: DataFrame, query: list[float], opts: SearchOptions = SearchOptions(), metric: str = "cosine", dimension: int | None = None) -> DataFrame:
    """Exact k nearest records to ``query``: collection, id, score, rank and attributes. Records without a vector never appear."""
    if metric not in V.METRICS:
        raise ValueError(f"metric is one of {V.METRICS}")
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} dimensions, the store {dimension}")
    rows = scoped(df, opts.scope).where(compile_filter(opts.where, bind(df))).where("vector is not null")
    return tail(rows.withColumn("score", V.score(F.col("vector"), list(query), metric)), opts)


def reranked(find: Callable[[SearchOptions], DataFrame], opts: SearchOptions, query: str, text: str, reranker: R.Reranker = R.overlap_reranker, overscan: int = OVERSCAN) -> DataFrame:
    """A page of ``find`` (any search, as a function of its options) in the order of a reranker's scores for (query, ``text``).

    ``overscan`` pages are found, whatever columns the page shows, and scored;
    records without text come after all others, with the scores they have. The
    cap per value, the page and its columns apply to the new order.
    """
    if opts.diversity is not None or opts.min_score is not None:
        raise ValueError("not available with a reranker")
    end = opts.offset + opts.top_k
    deep = replace(opts, top_k=min(MAX_DEPTH, end * overscan), offset=0, limit_per=None, include=None, exclude=None)
    hits = R.rerank(find(deep).drop("rank"), query, text, reranker)
    if opts.limit_per is not None:
        hits = R.limit_per(hits, *opts.limit_per, R.rerank_order())
    window = Window.partitionBy(F.lit(0)).orderBy(*R.rerank_order())
    ranked = hits.orderBy(*R.rerank_order()).limit(end).withColumn("rank", (F.row_number().over(window) - 1).cast("long"))
    return project(ranked.where(F.col("rank") >= opts.offset).drop("passed"), opts)


def stored_vector(df: DataFrame, collection: str, id: str) -> list[float]:
    found = df.where((F.col("collection") == collection) & (F.col("id") == id)).select("vector").head(1)
    if not found or found[0]["vector"] is None:
        raise LookupError(f"no vector for {collection}/{id}")
    return list(found[0]["vector"])


def search_similar(df: DataFrame, collection: str, id: str, opts: SearchOptions = SearchOptions(), metric: str = "cosine") -> DataFrame:
    """Nearest records to a stored one, which itself is left out; caps and pages count without it."""
    query = stored_vector(df, collection, id)
    return search(df.where(~((F.col("collection") == collection) & (F.col("id") == id))), query, opts, metric)


class Best:
    """The ``k`` best of each query over any number of steps, in the order of ``ranking.order``: score, NaN last, then collection and id.

    A step holds (rows x queries) scores of STEP rows; between steps there are
    about 2 k hits a query, so neither the rows that are seen nor ties make it grow.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, queries
        self.least = np.full(queries, -np.inf)
        self.none()

    def none(self) -> None:
        self.of, self.score = [], []
        self.colls, self.ids, self.held = [], [], 0

    def add(self, s: np.ndarray, colls: pa.Array, ids: pa.Array, known: np.ndarray) -> None:
        order = np.where(np.isnan(s), -np.inf, s)
        order[~known] = -np.inf
        k = self.k
        if k < len(order) and np.isneginf(self.least).any():
            least = np.maximum(self.least, np.partition(order, -k, axis=0)[-k])
        else:
            least = self.least
        of, at = np.nonzero(((order >= least) & known[:, None]).T)
        if not len(of):
            return
        self._put(of, s[at, of], colls.take(pa.array(at)), ids.take(pa.array(at)))
        if self.held > 2 * k * self.rows + STEP:
            self._cut()

    def _put(self, of, score, colls, ids) -> None:
        self.of.append(of)
        self.score.append(score)
        self.colls.append(colls.cast(pa.string()))
        self.ids.append(ids.cast(pa.string()))
        self.held += len(of)

    def _cut(self) -> None:
        of, score = np.concatenate(self.of), np.concatenate(self.score)
        colls, ids = pa.concat_arrays(self.colls), pa.concat_arrays(self.ids)
        nan = np.isnan(score)
        table = pa.table({"of": of, "nan": nan.astype(np.int8), "s": np.where(nan, 0.0, -score), "c": colls, "i": ids})
        by = pc.sort_indices(table, [("of", "ascending"), ("nan", "ascending"), ("s", "ascending"), ("c", "ascending"), ("i", "ascending")]).to_numpy()
        sorted_of = of[by]
        starts = np.searchsorted(sorted_of, np.arange(self.rows))
        place = np.arange(len(by)) - starts[sorted_of]
        keep = by[place < self.k]
        last = by[place == self.k - 1]  # what a full query has at its end bounds what may come
        self.least[of[last]] = np.where(nan[last], -np.inf, score[last])
        self.none()
        self._put(of[keep], score[keep], colls.take(pa.array(keep)), ids.take(pa.array(keep)))

    def parts(self, size: int = 100_000):
        """(query, collection, id, score) of what is best, some at a time."""
        if self.held:
            self._cut()
            for at in range(0, self.held, size):
                yield self.of[0][at : at + size], self.colls[0].slice(at, size), self.ids[0].slice(at, size), self.score[0][at : at + size]


def top_k_batch(df: DataFrame, queries: list[tuple[str, list[float]]], k: int, metric: str = "cosine") -> DataFrame:
    """(query, collection, id, score, rank): the k nearest records to each of any number of queries, in one pass.

    Every STEP rows are scored against all queries by one matrix product; a task
    gives its k best of each query, and the rest is a ranking per query.
    """
    names = [n for n, _ in queries]
    m = np.array([v for _, v in queries], np.float64)
    out = T.StructType([T.StructField("query", T.StringType()), T.StructField("collection", T.StringType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                rows, known = V.matrix(b.column(2))
                if known.any():
                    best.add(V.scores(rows, m, metric), b.column(0), b.column(1), known)
        for of, colls, ids, score in best.parts():
            cols = [asked.take(pa.array(of)), colls, ids, pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    if not names or k < 1:
        return df.sparkSession.createDataFrame([], out.add("rank", "long"))
    asked = pa.array(names, pa.string())
    best = df.where("vector is not null").select("collection", "id", "vector").mapInArrow(run, out)
    window = Window.partitionBy("query").orderBy(*R.order())
    return best.withColumn("rank", (F.row_number().over(window) - 1).cast("long")).where(F.col("rank") < k)


def top_k_blocks(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """``top_k_batch`` for a table of queries (query, vector) of any size.

    The queries are written in numbered blocks of about ``block``. One block at
    a time is on the driver and in the tasks, for one pass over the records whose
    result is written; so neither grows with the number of queries.
    """
    queries = queries.where("vector is not null").select(F.col("query").cast("string").alias("query"), "vector")
    blocks = max(1, -(-queries.count() // block))
    numbered = materialize(queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")))
    parts = []
    for i in range(blocks):
        some = numbered.where(F.col("block") == i).toArrow()
        part = top_k_batch(df, list(zip(some["query"].to_pylist(), some["vector"].to_pylist(), strict=True)), k, metric)
        parts.append(part if blocks == 1 else materialize(part))
    return reduce(DataFrame.unionAll, parts)


def search_batch(df: DataFrame, requests: list[tuple[list[float], SearchOptions]], metric: str = "cosine", fuse: bool = False, weights: list[float] | None = None, k: float = 60.0, top_k: int = 10) -> DataFrame:
    """Several searches at once, each with its own filter and scope; with ``fuse`` joined to one ranking.

    Requests that differ in their vectors only share one pass over the records.
    Without ``fuse`` the result has a column ``query``, the request's number.
    """
    if not 1 <= len(requests) <= MAX_BATCH:
        raise ValueError(f"from 1 to {MAX_BATCH} queries")
    plain = SearchOptions()
    same = all(replace(o, top_k=requests[0][1].top_k) == replace(plain, where=requests[0][1].where, scope=requests[0][1].scope, top_k=requests[0][1].top_k) for _, o in requests) and len({o.top_k for _, o in requests}) == 1
    if same:
        o = requests[0][1]
        rows = scoped(df, o.scope).where(compile_filter(o.where, bind(df)))
        hits = top_k_batch(rows, [(str(i), q) for i, (q, _) in enumerate(requests)], o.top_k, metric).withColumn("query", F.col("query").cast("int"))
    else:
        hits = None
        for i, (q, o) in enumerate(requests):
            one = search(df, q, o, metric).select(F.lit(i).alias("query"), "collection", "id", "score", "rank")
            hits = one if hits is None else hits.unionByName(one)
    if not fuse:
        return hits
    legs = [hits.where(F.col("query") == i).drop("query") for i in range(len(requests))]
    fused = R.fuse(legs, weights, k).drop("legs")
    return fused.orderBy(*R.order()).limit(top_k)
