"""Full-text search: an inverted index as a table, BM25, and hybrid fusion with vectors.

The index is one map-only pass over the text: a row (collection, field, term, id,
tf, len) per posting, and rows with a NULL term for the statistics: tf documents
with len terms in all. Searches without a stored index make the rows of the
query's terms only, and keep them in the shared folder while they score.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.analysis import Analyzer, Highlight
from ..functions.filters import bind, compile_filter
from ..functions.partitions import materialize, spread
from . import ranking as R
from . import search as S

INDEX = T.StructType([T.StructField(n, t) for n, t in (("collection", T.StringType()), ("field", T.StringType()), ("term", T.StringType()), ("id", T.StringType()), ("tf", T.LongType()), ("len", T.LongType()))])


@dataclass(frozen=True)
class FieldSchema:
    """A searchable attribute with its BM25 parameters and analyzer."""

    field: str
    k1: float = 1.2
    b: float = 0.75
    analyzer: Analyzer = Analyzer()

    def __post_init__(self):
        if not self.field or self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("bad field schema")


def build_index(df: DataFrame, schema: list[FieldSchema], only: dict[str, set[str]] | None = None) -> DataFrame:
    """Index rows of the fields of ``schema``; a list is joined with blanks, empty text is not indexed.

    ``only`` keeps the postings of some terms per field; statistics are of all terms.
    """
    if len({s.field for s in schema}) != len(schema):
        raise ValueError("a field is declared twice")
    have = {f.name: f.dataType for f in df.schema}
    schema = [s for s in schema if isinstance(have.get(s.field), (T.StringType, T.ArrayType))]
    if not schema:
        return df.sparkSession.createDataFrame([], INDEX)
    texts = [(F.array_join(s.field, " ") if isinstance(have[s.field], T.ArrayType) else F.col(s.field)).alias(f"t{i}") for i, s in enumerate(schema)]
    arrow = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in INDEX]
            colls, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, s in enumerate(schema):
                wanted = None if only is None else only.get(s.field, set())
                totals: dict[str, list[int]] = {}
                for coll, id, text in zip(colls, ids, b.column(2 + i).to_pylist(), strict=True):
                    if not text:
                        continue
                    counts = Counter(s.analyzer.terms(text))
                    length = sum(counts.values())
                    found = counts if wanted is None else {t: counts[t] for t in wanted & counts.keys()}
                    for term, tf in found.items():
                        for c, v in zip(cols, (coll, s.field, term, id, tf, length), strict=True):
                            c.append(v)
                    total = totals.setdefault(coll, [0, 0])
                    total[0] += 1
                    total[1] += length
                for coll, (n, length) in totals.items():
                    for c, v in zip(cols, (coll, s.field, None, None, n, length), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return spread(df.select("collection", "id", *texts)).mapInArrow(run, INDEX)


def save_index(index: DataFrame, path: str) -> None:
    """Store an index by field, sorted by term, so that a search reads the row groups of its terms."""
    index.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*INDEX.names)


@dataclass(frozen=True)
class TextQuery:
    """Clauses (field, text), joined by sum or by max."""

    clauses: list[tuple[str, str]]
    combine: str = "sum"

    def __post_init__(self):
        if not self.clauses or self.combine not in ("sum", "max"):
            raise ValueError("a text query has clauses, joined by sum or max")

    def terms(self, schema: list[FieldSchema]) -> dict[str, set[str]]:
        by = {s.field: s for s in schema}
        out: dict[str, set[str]] = {}
        for field, text in self.clauses:
            if field in by:
                out.setdefault(field, set()).update(by[field].analyzer.terms(text))
        return out


def bm25(index: DataFrame, schema: list[FieldSchema], query: TextQuery) -> DataFrame:
    """(collection, id, score, clauses): documents that match a clause; clauses lists (clause, field, score) of those.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N, df and the mean length of
    the collection's documents in that field, whatever is filtered later. A term
    counts once however often the query has it. Clauses on fields that aren't
    indexed give nothing.
    """
    by = {s.field: s for s in schema}
    parts = []
    for i, (field, text) in enumerate(query.clauses):
        terms = sorted(set(by[field].analyzer.terms(text))) if field in by else []
        if not terms:
            continue
        s = by[field]
        own = index.where(F.col("field") == field)
        stats = own.where("term is null").groupBy("collection").agg(F.sum("tf").alias("n"), (F.sum("len") / F.sum("tf")).alias("mean"))
        postings = own.where(F.col("term").isin(terms))
        frequency = postings.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "collection")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
        tf = F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("len") / mean))
        scored = postings.join(frequency, ["collection", "term"]).groupBy("collection", "id").agg(F.sum(idf * tf).alias("score"))
        parts.append(scored.select("collection", "id", F.lit(i).alias("clause"), F.lit(field).alias("field"), "score"))
    if not parts:
        return index.sparkSession.createDataFrame([], "collection string, id string, score double, clauses array<struct<clause:int,field:string,score:double>>")
    fold = F.sum("score") if query.combine == "sum" else F.greatest(F.max("score"), F.lit(0.0))
    return reduce(DataFrame.unionByName, parts).groupBy("collection", "id").agg(fold.alias("score"), F.array_sort(F.collect_list(F.struct("clause", "field", "score"))).alias("clauses"))


def text_search(df: DataFrame, query: TextQuery, schema: list[FieldSchema], opts: S.SearchOptions = S.SearchOptions(), index: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """Best documents by BM25: collection, id, score, rank, attributes, and with ``explain`` the clauses' scores.

    The filter applies after scoring, so statistics are of all documents in scope.
    """
    rows = S.scoped(df, opts.scope)
    index = materialize(build_index(rows, schema, query.terms(schema))) if index is None else S.scoped(index, opts.scope)
    hits = bm25(index, schema, query)
    if not explain:
        hits = hits.drop("clauses")
    # The page is cut from narrow rows; whole records are read back for what is left of them.
    keys = ["collection", "id"]
    where = compile_filter(opts.where, bind(df))
    if opts.where is not None:
        hits = hits.join(rows.where(where).select(*keys), keys, "left_semi")
    if opts.rank_by is None and opts.min_score is None:
        hits = hits.orderBy(*R.order()).limit(opts.depth)
    return S.tail(rows.where(where).join(F.broadcast(hits) if opts.rank_by is None and opts.min_score is None else hits, keys), opts)


def hybrid_search(df: DataFrame, vector: list[float], query: TextQuery, schema: list[FieldSchema], opts: S.SearchOptions = S.SearchOptions(), candidates: int = 100, weights: tuple[float, float] = (1.0, 1.0), k: float = 60.0, metric: str = "cosine", index: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Vector and text rankings fused by reciprocal ranks; ``legs`` has (leg, rank, score) with leg 0 for the vector.

    Both legs apply the filter and are max(candidates, page) deep; the page is
    cut from the fused ranking. Score bounds, decay, caps and diversity have no
    meaning here. ``vectors`` (collection, id, vector) has the records' vectors
    where they stand in a table of their own. Legs and fusion are of keys and scores; whole
    records are read back for the page.
    """
    if opts.min_score is not None or opts.rank_by or opts.limit_per or opts.diversity is not None:
        raise ValueError("not available in hybrid search")
    keys = ["collection", "id"]
    deep = S.SearchOptions(top_k=max(candidates, opts.offset + opts.top_k), where=opts.where, scope=opts.scope, include=[])
    rows = S.scoped(df, opts.scope).where(compile_filter(opts.where, bind(df)))
    if vectors is None:
        nearest = S.search(df, vector, deep, metric)
    else:
        scored = S.scoped(vectors, opts.scope).where("vector is not null").select(*keys, V.score(F.col("vector"), list(vector), metric).alias("score"))
        nearest = S.tail(scored.join(rows.select(*keys), keys), S.SearchOptions(top_k=deep.top_k, include=[]))
    fused = R.fuse([nearest, text_search(df, query, schema, deep, index)], list(weights), k)
    window = Window.partitionBy(F.lit(0)).orderBy(*R.order())
    page = fused.orderBy(*R.order()).limit(opts.offset + opts.top_k).withColumn("rank", (F.row_number().over(window) - 1).cast("long"))
    page = page.where(F.col("rank") >= opts.offset)
    attrs = [c for c in df.columns if c not in (*page.columns, "vector", "row")]
    return S.project(rows.select(*keys, *attrs).join(F.broadcast(page), keys).dropDuplicates(keys).select(*page.columns, *attrs), opts).orderBy("rank")


def highlight(page: DataFrame, query: TextQuery, schema: list[FieldSchema], opts: Highlight = Highlight()) -> DataFrame:
    """``page`` with ``highlights``: for each queried field its fragments, as JSON, from the stored text."""
    by = {s.field: s for s in schema}
    terms = query.terms(schema)
    fields = [f for f in terms if f in page.columns]

    @F.arrow_udf("string")
    def of(*cols: pa.Array) -> pa.Array:
        out = []
        for texts in zip(*[c.to_pylist() for c in cols], strict=True):
            out.append(json.dumps({f: opts.fragments(t, terms[f], by[f].analyzer) for f, t in zip(fields, texts, strict=True) if t}, ensure_ascii=False))
        return pa.array(out, pa.string())

    return page.withColumn("highlights", of(*[F.col(f) for f in fields]) if fields else F.lit("{}"))
