"""Queries over the given tables, one or more for each operator, and their DuckDB oracles.

A table is a collection: its name is the collection, its key as a string the id,
its other columns the attributes (SQL NULL means absent).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import chunking as C
from ..functions import filters as P
from ..functions.partitions import materialize, spread
from ..operators import ann, expand, findex, fts, listing
from ..operators import ranking as R
from ..operators import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- bindings ---------------------------------------------------------------------------------------------------

KEYS = {"embeddings": "vec_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, key = table(spark, sf_dir, name), KEYS[name]
    df = df.select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"), F.col(key).cast("long").alias("row"), *[F.col(c) for c in df.columns if c != key])
    return df.withColumnRenamed("embedding", "vector") if name == "embeddings" else df


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir, "embeddings")


def vec(df: DataFrame, id: str) -> list[float]:
    return S.stored_vector(df, "embeddings", id)


def hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


# --- vector search ----------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def knn_sql(score: str = COS, q: int = 0, where: str = "true", k: int = 10, offset: int = 0, more: str = "") -> str:
    return f"""
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = {q}),
    s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, {score} AS s, e.label AS label FROM embeddings e, q WHERE {where}),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM s)
    SELECT id, round(s, 6) AS score, rank{more} FROM r WHERE rank >= {offset} AND rank < {offset + k}"""


@query(knn_sql())
def knn_cosine(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0")))


@query(knn_sql("list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", q=3))
def knn_dot(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "3"), metric="dot"))


@query(knn_sql("-pow(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 2)", q=5))
def knn_euclidean(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "5"), metric="euclidean"))


@query(knn_sql(where="e.label <> 3", more=", label"))
def knn_filtered(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0"), S.SearchOptions(where=P.Ne("label", 3))), "label")


@query(knn_sql(where=f"{COS} >= 0.2", k=50))
def knn_min_score(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0"), S.SearchOptions(top_k=50, min_score=0.2)))


@query(knn_sql(offset=20, k=10))
def knn_page(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0"), S.SearchOptions(offset=20)))


@query(knn_sql(q=7, where="e.vec_id <> 7"))
def knn_similar(spark, d):
    return hits(S.search_similar(emb(spark, d), "embeddings", "7"))


BATCH = """
    WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 20 = 0),
    r AS (SELECT q.query, CAST(e.vec_id AS VARCHAR) AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
        row_number() OVER (PARTITION BY q.query ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, CAST(e.vec_id AS VARCHAR)) - 1 AS rank
      FROM embeddings e, q)
    SELECT query, id, round(s, 6) AS score, rank FROM r WHERE rank < 10"""


def asked(df: DataFrame) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return df.where("row % 20 = 0").select(F.col("id").alias("query"), "vector")


def batch_hits(df: DataFrame) -> DataFrame:
    return df.select(F.col("query").cast("long").alias("query"), "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(BATCH)
def knn_batch(spark, d):
    """Ten nearest to every vector whose id is divisible by 20, in blocks of queries against one scan each."""
    df = emb(spark, d)
    return batch_hits(S.top_k_blocks(df, asked(df), 10))


@query("""
    WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id IN (1, 2, 4)),
    r AS (SELECT q.query, CAST(e.vec_id AS VARCHAR) AS id,
        row_number() OVER (PARTITION BY q.query ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, CAST(e.vec_id AS VARCHAR)) AS rn
      FROM embeddings e, q),
    f AS (SELECT id, sum(CASE query WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 2.0 END / (60 + rn)) AS s FROM r WHERE rn <= 20 GROUP BY id)
    SELECT id, round(s, 6) AS score FROM f ORDER BY s DESC, id LIMIT 10""")
def knn_batch_rrf(spark, d):
    df = emb(spark, d)
    o = S.SearchOptions(top_k=20)
    got = S.search_batch(df, [(vec(df, i), o) for i in ("1", "2", "4")], fuse=True, weights=[1.0, 0.5, 2.0])
    return got.select("id", F.round("score", 6).alias("score"))


@query(f"""
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, {COS} AS s, label FROM embeddings e, q ORDER BY s DESC, id LIMIT 80),
    c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, id) AS n FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM c WHERE n <= 2)
    SELECT id, round(s, 6) AS score, rank, label FROM r WHERE rank < 10""")
def knn_limit_per_label(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0"), S.SearchOptions(limit_per=("label", 2))), "label")


@query()
def knn_mmr(spark, d):
    df = emb(spark, d)
    return hits(S.search(df, vec(df, "0"), S.SearchOptions(diversity=0.5)))


@query(knn_sql())
def knn_int8(spark, d):
    df = emb(spark, d)
    coded, scale = ann.add_int8(df)
    return hits(ann.search_int8(coded, vec(df, "0"), scale))


@query()
def knn_binary(spark, d):
    """Sign bits at the default depth, which leaves most records out, so the result is approximate."""
    df = emb(spark, d)
    return hits(ann.search_binary(ann.add_signs(df, 64), vec(df, "0")))


@query()
def knn_ivf(spark, d):
    df = emb(spark, d)
    index = ann.fit_ivf(df)
    return hits(ann.search_ivf(index.assign(df), index, vec(df, "0")))


@query(knn_sql(where="e.label = 4", more=", label"))
def knn_ivf_filtered(spark, d):
    """A selective filter leaves few records, which are scored exactly."""
    df = emb(spark, d)
    index = ann.fit_ivf(df)
    return hits(ann.search_ivf(index.assign(df), index, vec(df, "0"), S.SearchOptions(where=P.Eq("label", 4))), "label")


@query()
def knn_hnsw_contract(spark, d):
    df = emb(spark, d)
    index = ann.fit_ivf(df)
    return hits(ann.search_hnsw(index.assign(df), index, vec(df, "0")))


def measured(df: DataFrame, found: DataFrame) -> DataFrame:
    """Of each query its ten nearest by brute force, how many of them an index found, and the share."""
    got = ann.recall_by_query(found, S.top_k_blocks(df, asked(df), 10))
    return got.select(F.col("query").cast("long").alias("query"), "n", "found", (F.col("found") / F.col("n")).alias("recall"))


@query()
def recall_ivf(spark, d):
    """An inverted file over all vectors, at the probes that sampled vectors need for a recall of 0.95, against brute force."""
    df = emb(spark, d)
    index = ann.fit_ivf(df)
    indexed = materialize(index.assign(df))
    return measured(df, ann.search_ivf_batch(indexed, index, asked(df), 10, ann.choose_probes(indexed, index)))


@query()
def recall_hnsw_contract(spark, d):
    """The graph index's contract at a higher target."""
    df = emb(spark, d)
    index = ann.fit_ivf(df)
    indexed = materialize(index.assign(df))
    return measured(df, ann.search_ivf_batch(indexed, index, asked(df), 10, ann.choose_probes(indexed, index, target=0.98)))


@query()
def recall_int8(spark, d):
    df = emb(spark, d)
    return measured(df, ann.search_codes_batch(df, asked(df), 10))


@query()
def recall_binary(spark, d):
    df = emb(spark, d)
    return measured(df, ann.search_codes_batch(df, asked(df), 10, "binary"))


@query()
def tune_probes(spark, d):
    cells = ann.tune(emb(spark, d))
    return spark.createDataFrame(cells, "probes int, recall double, p50_ms double, p95_ms double, recommended boolean")


# --- filters ----------------------------------------------------------------------------------------------------


def filtered(name: str, coll: str, p: P.Predicate, where: str) -> None:
    """Register a filter query over a whole table: ids that pass."""
    QUERIES[name] = lambda spark, d: collection(spark, d, coll).where(P.compile_filter(p, P.Columns(collection(spark, d, coll)))).select("id")
    ORACLES[name] = f"SELECT CAST({KEYS[coll]} AS VARCHAR) AS id FROM {coll} WHERE {where}"


filtered("filter_eq", "orders", P.Eq("o_orderstatus", "F"), "o_orderstatus = 'F'")
filtered("filter_eq_other_type", "orders", P.Eq("o_orderstatus", 1), "false")
filtered("filter_ne", "orders", P.Ne("o_orderstatus", "F"), "o_orderstatus <> 'F'")
filtered("filter_in", "customer", P.In("c_mktsegment", ["BUILDING", "MACHINERY", 7]), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
filtered("filter_not_in", "customer", P.NotIn("c_nationkey", [1, 2, 3]), "c_nationkey NOT IN (1, 2, 3)")
filtered("filter_lt", "orders", P.Lt("o_totalprice", 50000.0), "o_totalprice < 50000")
filtered("filter_le_datetime", "orders", P.Le("o_orderdate", P.DateTime(820454400000)), "epoch_ms(o_orderdate) <= 820454400000")
filtered("filter_gt_datetime", "events", P.Gt("ts", P.DateTime(1705000000000)), "epoch_ms(ts) > 1705000000000")
filtered("filter_ge", "part", P.Ge("p_size", 40), "p_size >= 40")
filtered("filter_glob", "part", P.Glob("p_type", "?[!A-L]*[DM]*"), "p_type GLOB '?[!A-L]*[DM]*'")
filtered("filter_iglob", "part", P.IGlob("p_brand", "BRAND#1?"), "lower(p_brand) GLOB 'brand#1?'")
filtered("filter_regex", "pages", P.Regex("url", r"https?://[^/]*/.*[0-4]\D*"), r"regexp_full_match(url, 'https?://[^/]*/.*[0-4]\D*')")
filtered("filter_fuzzy", "part", P.Fuzzy("p_brand", "brand#12", 1), "levenshtein(lower(p_brand), 'brand#12') <= 1")
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
filtered("filter_tokens_all", "documents", P.ContainsAllTokens("text", "that the With"), f"list_has_all({TOKENS}, ['that', 'the', 'with'])")
filtered("filter_tokens_any", "documents", P.ContainsAnyToken("text", "idiot licensed"), f"list_has_any({TOKENS}, ['idiot', 'licensed'])")
filtered("filter_token_sequence", "documents", P.ContainsTokenSequence("text", "is licensed under"), f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' is licensed under ')")
filtered("filter_all_any", "orders", P.All([P.Any_([P.Eq("o_orderstatus", "O"), P.Gt("o_totalprice", 300000.0)]), P.Not(P.Glob("o_orderpriority", "1*"))]), "(o_orderstatus = 'O' OR o_totalprice > 300000) AND NOT o_orderpriority GLOB '1*'")

LABELLED = "documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, quality, toxic FROM labels) l USING (doc_id)"


def labelled(spark, d):
    """Documents with the attributes quality and toxic, which most lack."""
    return collection(spark, d, "documents").join(collection(spark, d, "labels").select("id", "quality", "toxic").dropDuplicates(["id"]), "id", "left")


def _on_labelled(name: str, p: P.Predicate, where: str) -> None:
    QUERIES[name] = lambda spark, d: labelled(spark, d).where(P.compile_filter(p, P.Columns(labelled(spark, d)))).select("id")
    ORACLES[name] = f"SELECT CAST(d.doc_id AS VARCHAR) AS id FROM {LABELLED} WHERE {where}"


_on_labelled("filter_not_eq_absent", P.Not(P.Eq("toxic", 1)), "coalesce(l.toxic <> 1, true)")
_on_labelled("filter_ne_absent", P.Ne("toxic", 1), "l.toxic <> 1")
_on_labelled("filter_not_nested", P.Not(P.Any_([P.Eq("toxic", 1), P.Not(P.Ge("quality", 1))])), "NOT (coalesce(l.toxic = 1, false) OR NOT coalesce(l.quality >= 1, false))")

ROLES = "(SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)"


def roles(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return t.select(F.lit("conversations").alias("collection"), F.col("conv_id").cast("string").alias("id"), "roles")


def _on_roles(name: str, p: P.Predicate, where: str) -> None:
    QUERIES[name] = lambda spark, d: roles(spark, d).where(P.compile_filter(p, P.Columns(roles(spark, d)))).select("id")
    ORACLES[name] = f"SELECT CAST(conv_id AS VARCHAR) AS id FROM {ROLES} WHERE {where}"


_on_roles("filter_contains", P.Contains("roles", "system"), "list_contains(roles, 'system')")
_on_roles("filter_not_contains", P.NotContains("roles", "system"), "NOT list_contains(roles, 'system')")
_on_roles("filter_contains_any", P.ContainsAny("roles", ["system", "tool"]), "list_has_any(roles, ['system', 'tool'])")

FINDEX = P.All([P.ContainsAllTokens("text", "licensed under"), P.Not(P.Eq("lang", "de"))])


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_all({TOKENS}, ['licensed', 'under']) AND NOT coalesce(lang = 'de', false)")
def findex_tokens(spark, d):
    df = collection(spark, d, "documents")
    fields = [findex.FilterField("text")]
    return findex.narrowed(df, FINDEX, findex.build(df, fields), fields).select("id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE levenshtein(lower(p_name), 'smoll ring') <= 1")
def findex_fuzzy(spark, d):
    df = collection(spark, d, "part")
    fields = [findex.FilterField("p_name", tokens=False, trigrams=True)]
    return findex.narrowed(df, P.Fuzzy("p_name", "smoll ring", 1), findex.build(df, fields), fields, worth=None).select("id")


# --- ranking, listing, aggregation --------------------------------------------------------------------------------


@query("""
    WITH s AS (SELECT CAST(event_id AS VARCHAR) AS id, value - 1.0 * (1 - pow(0.5, greatest(1706659200000 - epoch_ms(ts), 0) / 604800000.0)) AS s FROM events),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM s)
    SELECT id, round(s, 6) AS score, rank FROM r WHERE rank < 50""")
def decay_recency(spark, d):
    df = collection(spark, d, "events").withColumn("score", F.col("value"))
    return hits(S.tail(df, S.SearchOptions(top_k=50, rank_by=R.Decay(1706659200000, "ts"))))


@query("""
    WITH s AS (SELECT CAST(event_id AS VARCHAR) AS id, value - 0.5 * (1 - n / (n + 10.0)) AS s FROM (SELECT *, greatest(CAST(props ->> '$.k' AS DOUBLE), 0) AS n FROM events)),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM s)
    SELECT id, round(s, 6) AS score, rank FROM r WHERE rank < 50""")
def decay_count(spark, d):
    df = collection(spark, d, "events").withColumn("score", F.col("value")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return hits(S.tail(df, S.SearchOptions(top_k=50, rank_by=R.Decay(count_field="k", count_weight=0.5))))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def list_order_desc(spark, d):
    return listing.list_records(collection(spark, d, "orders"), P.Eq("o_orderstatus", "O"), order_by="o_totalprice", descending=True, include=["o_totalprice"]).select("id", "o_totalprice")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 40 OFFSET 30")
def list_order_page(spark, d):
    return listing.list_records(collection(spark, d, "orders"), order_by="o_orderpriority", offset=30, limit=40).select("id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100")
def list_projection(spark, d):
    return listing.list_records(collection(spark, d, "customer"), exclude=["c_name", "c_nationkey"]).drop("collection", "score", "rank")


@query(f"SELECT CAST(d.doc_id AS VARCHAR) AS id FROM {LABELLED} ORDER BY l.quality IS NULL, l.quality DESC, d.doc_id LIMIT 500")
def list_order_absent(spark, d):
    return listing.list_records(labelled(spark, d), order_by="quality", descending=True, limit=500).select("id")


@query("SELECT count(*) AS n, sum(l_quantity) AS sum_l_quantity, CAST(sum(l_partkey) AS DOUBLE) AS sum_l_partkey FROM lineitem WHERE l_discount >= 0.05")
def agg_count_sum(spark, d):
    df = table(spark, d, "lineitem").withColumn("collection", F.lit("lineitem"))
    return listing.aggregate(df, P.Ge("l_discount", 0.05), sums=["l_quantity", "l_partkey"])


@query("""
    SELECT grouping(event_type) = 1 AS is_total, event_type AS grp, CASE WHEN grouping(event_type) = 0 THEN event_type IS NOT NULL END AS present,
        count(*) AS n, round(sum(value), 4) AS sum_value, false AS groups_truncated
    FROM events GROUP BY ROLLUP (event_type)""")
def agg_group_by(spark, d):
    got = listing.aggregate(collection(spark, d, "events"), sums=["value"], group_by="event_type")
    return got.withColumn("sum_value", F.round("sum_value", 4))


@query(f"""
    SELECT grouping(t) = 1 AS is_total, nullif(t, '!') AS grp, CASE WHEN grouping(t) = 0 THEN t <> '!' END AS present, count(*) AS n, false AS groups_truncated
    FROM (SELECT coalesce(CAST(l.toxic AS VARCHAR), '!') AS t FROM {LABELLED}) GROUP BY ROLLUP (t)""")
def agg_group_absent(spark, d):
    return listing.aggregate(labelled(spark, d), group_by="toxic")


@query("SELECT count(embedding) AS rows, count(*) AS docs, 64 AS dimension, count(embedding) * 256 AS vector_bytes FROM embeddings")
def footprint(spark, d):
    return listing.footprint(emb(spark, d), 64)


# --- full text --------------------------------------------------------------------------------------------------

PLAIN = [fts.FieldSchema("text", analyzer=A.Analyzer(stem=False, stopwords=False, fold=False))]
FULL = [fts.FieldSchema("text")]


def bm25_sql(clauses: list[list[str]], fold: str, k: int = 20) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s
        FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term), st WHERE term IN ({", ".join(f"'{t}'" for t in c)}) GROUP BY id"""
        for c in clauses
    )
    return f"""
    WITH t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents WHERE text <> ''),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    p AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, unnest(w) AS term, len(w) AS len FROM t) GROUP BY id, term),
    c AS ({parts}), f AS (SELECT CAST(id AS VARCHAR) AS id, {fold}(s) AS s FROM c GROUP BY id),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM f)
    SELECT id, round(s, 6) AS score, rank FROM r WHERE rank < {k}"""


def _bm25(spark, d, clauses, combine="sum", k=20):
    return hits(fts.text_search(collection(spark, d, "documents"), fts.TextQuery(clauses, combine), PLAIN, S.SearchOptions(top_k=k)))


@query(bm25_sql([["licensed"]], "sum"))
def bm25_single(spark, d):
    return _bm25(spark, d, [("text", "licensed")])


@query(bm25_sql([["token", "apache", "license"], ["version", "the"]], "sum"))
def bm25_multi_sum(spark, d):
    return _bm25(spark, d, [("text", "token Apache license"), ("text", "version the the")])


@query(bm25_sql([["token", "apache", "license"], ["version", "the"]], "max"))
def bm25_multi_max(spark, d):
    return _bm25(spark, d, [("text", "token Apache license"), ("text", "version the"), ("source", "src1")], "max")


@query()
def bm25_analyzed_explain(spark, d):
    got = fts.text_search(collection(spark, d, "documents"), fts.TextQuery([("text", "licensing the works"), ("text", "released")]), FULL, explain=True)
    return hits(got, F.to_json("clauses").alias("clauses"))


@query()
def highlight(spark, d):
    q = fts.TextQuery([("text", "licensed license")])
    got = fts.text_search(collection(spark, d, "documents"), q, FULL)
    return hits(fts.highlight(got, q, FULL, A.Highlight(2, 120)), "highlights")


HYBRID = f"""
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 11),
    v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM (SELECT CAST(e.vec_id AS VARCHAR) AS id, {COS} AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q)),
    x AS ({bm25_sql([["licensed", "token"]], "sum", 100)}),
    f AS (SELECT id, sum(w / (60 + rank + 1)) AS s FROM (SELECT id, rank, 1.0 AS w FROM v WHERE rank < 100 UNION ALL SELECT id, rank, 2.0 FROM x) GROUP BY id),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM f)
    SELECT id, round(s, 6) AS score, rank FROM r WHERE rank < 15"""


@query(HYBRID)
def hybrid_rrf(spark, d):
    """All documents, those that have a vector of the same number ranked by it, fused with a text ranking."""
    e = emb(spark, d)
    df, vectors = collection(spark, d, "documents"), e.select(F.lit("documents").alias("collection"), "id", "vector")
    q = fts.TextQuery([("text", "licensed token")])
    return hits(fts.hybrid_search(df, vec(e, "11"), q, PLAIN, S.SearchOptions(top_k=15), weights=(1.0, 2.0), vectors=vectors))


def reranked_sql(found: str, words: list[str], page: str = "rank < 10", cap: str = "true", more: str = "") -> str:
    """The ids of ``found`` by the share of the words in their text, and a tenth of their density."""
    q = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""
    WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, {TOKENS} AS w FROM documents WHERE text <> ''),
    s AS (SELECT id, source, len(list_intersect(list_distinct(w), {q})) / {len(words)}.0 + 0.1 * len(list_filter(w, lambda x: list_contains({q}, x))) / greatest(1, len(w)) AS s
      FROM w JOIN ({found}) f USING (id)),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, id) AS n FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM c WHERE {cap})
    SELECT id, round(s, 6) AS score, rank{more} FROM r WHERE {page}"""


@query(reranked_sql(bm25_sql([["licensed", "apache"]], "sum", 100), ["apache", "license", "version"]))
def rerank_search(spark, d):
    """Ten pages of a text search, in the order of a reranker."""
    df, q = collection(spark, d, "documents"), fts.TextQuery([("text", "licensed apache")])
    return hits(S.reranked(lambda o: fts.text_search(df, q, PLAIN, o), S.SearchOptions(include=[]), "apache license version", "text"))


@query(reranked_sql(bm25_sql([["licensed", "apache"]], "sum", 150), ["apache", "license", "version"], "rank BETWEEN 5 AND 14", "n <= 2", ", source"))
def rerank_capped_page(spark, d):
    """Two documents a source at most, counted and paged after the reranker."""
    df, q = collection(spark, d, "documents"), fts.TextQuery([("text", "licensed apache")])
    return hits(S.reranked(lambda o: fts.text_search(df, q, PLAIN, o), S.SearchOptions(offset=5, limit_per=("source", 2), include=["source"]), "apache license version", "text"), "source")


@query(reranked_sql(HYBRID.replace("rank < 15", "rank < 100"), ["apache", "license", "version"]))
def rerank_hybrid(spark, d):
    """A hybrid search's fused ranking, in the order of a reranker."""
    e = emb(spark, d)
    df, vectors = collection(spark, d, "documents"), e.select(F.lit("documents").alias("collection"), "id", "vector")
    q = fts.TextQuery([("text", "licensed token")])
    return hits(S.reranked(lambda o: fts.hybrid_search(df, vec(e, "11"), q, PLAIN, o, weights=(1.0, 2.0), vectors=vectors), S.SearchOptions(), "apache license version", "text"))


@query()
def rerank_text(spark, d):
    q = fts.TextQuery([("text", "licensed apache")])
    window = fts.text_search(collection(spark, d, "documents"), q, FULL, S.SearchOptions(top_k=100))
    scored = R.rerank(window, "apache license version", "text")
    return scored.orderBy(*R.rerank_order()).limit(10).select("id", F.round("score", 6).alias("score"))


# --- chunks -----------------------------------------------------------------------------------------------------


def _chunked(mode):
    def run(spark, d):
        made = C.chunks(F.col("text"), C.ChunkOptions(mode, 600, 80))
        df = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(made).alias("pos", "c"))
        return df.select("doc_id", F.col("c.index").alias("index"), F.col("c.char_start").alias("char_start"), F.length("c.text").alias("n_chars"), F.md5("c.text").alias("md5"))

    return run


for _mode in ("recursive", "sentence", "markdown"):
    QUERIES[f"chunk_{_mode}"] = _chunked(_mode)


def turns(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.lit("conversations").alias("collection"), F.concat_ws("#", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("int").alias("turn"), "role", "text")


@query("""
    SELECT h.conv_id || '#' || h.turn AS id, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS context
    FROM conversations h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1
    WHERE h.role = 'assistant' AND c.text <> '' GROUP BY h.conv_id, h.turn""")
def expand_neighbours(spark, d):
    df = turns(spark, d)
    return expand.expand(df.where("role = 'assistant'"), df, 1, "text", "conv", "turn", None).where("context is not null").select("id", "context")


@query("""
    WITH s AS (SELECT conv_id, turn, conv_id || '#' || turn AS id, CAST(length(text) AS DOUBLE) AS s FROM conversations),
    top AS (SELECT * FROM s ORDER BY s DESC, id LIMIT 80),
    c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, id) AS n FROM top),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM c WHERE n <= 1)
    SELECT id, round(s, 6) AS score, rank FROM r WHERE rank < 10""")
def rollup_per_parent(spark, d):
    df = turns(spark, d).withColumn("score", F.length("text").cast("double"))
    return hits(S.tail(df, expand.rollup(S.SearchOptions(), 1, "conv")))
