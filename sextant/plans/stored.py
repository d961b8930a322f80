"""Queries through a store: the operations of the write path over the given tables, with oracles for the state they leave.

Each builds a store of its own in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import filters as P
from ..functions.partitions import checkpoint_folder
from ..operators import listing
from ..operators import search as S
from ..operators.memory import Memory, alive
from ..sources import records as J
from ..sources import store as St
from .catalog import ORACLES, QUERIES, collection, query, table

NOW = 1705000000000


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order as upserts of their user."""
    e = table(spark, sf_dir, "events").orderBy("event_id")
    return e.select(F.col("user_id").cast("string").alias("id"), "event_id", "event_type", "value")


def shown(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    return P.promote(df, keys).select("id", *keys)


USER = {"event_id": "int", "event_type": "str", "value": "float"}
LAST = "SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE {} GROUP BY user_id"


@query(LAST.format("true"))
def store_fold(spark, d):
    s = St.Store(spark, scratch(spark), 64)
    s.upsert(users(spark, d), "users")
    return shown(s.records(), USER)


@query(f"SELECT * FROM ({LAST.format('true')}) WHERE NOT (value < 50 AND event_type <> 'click')")
def store_delete_where(spark, d):
    s = St.Store(spark, scratch(spark), 64)
    s.upsert(users(spark, d), "users")
    s.delete_where(P.All([P.Lt("value", 50.0), P.Ne("event_type", "click")]))
    return shown(s.records(), USER)


@query(LAST.format("event_id % 2 = 0"))
def store_time_travel(spark, d):
    """The state at the version before the odd events were written."""
    s = St.Store(spark, scratch(spark), 64)
    e = users(spark, d)
    s.upsert(e.where("event_id % 2 = 0"), "users")
    then = s.version
    s.upsert(e.where("event_id % 2 = 1"), "users")
    return shown(s.at(then).records(), USER)


@query(LAST.format("true"))
def store_compact(spark, d):
    s = St.Store(spark, scratch(spark), 64)
    e = users(spark, d)
    s.upsert(e.where("event_id % 3 > 0"), "users")
    s.upsert(e.where("event_id % 3 = 0").limit(0), "users")
    s.upsert(e, "users")
    s.compact()
    s.vacuum()
    return shown(s.records(), USER)


@query("SELECT CAST(user_id AS VARCHAR) AS id, count(*) FILTER (event_type = 'click') AS mem_access_count FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0")
def store_reinforce(spark, d):
    """Every click counts as an access of its user."""
    s = St.Store(spark, scratch(spark), 64)
    e = users(spark, d)
    s.upsert(e, "users")
    s.reinforce("users", e.where("event_type = 'click'"), NOW)
    return shown(s.records(), {St.COUNT: "int"}).where(F.col(St.COUNT).isNotNull())


EXPIRING = f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE NOT (event_type <> 'click' AND epoch_ms(ts) <= {NOW})"


def _expiring(spark, d) -> DataFrame:
    """Events that expire at their time, but for clicks, which don't."""
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") != "click", F.col("ts")).alias(St.EXPIRES))


@query(EXPIRING)
def store_sweep_expired(spark, d):
    s = St.Store(spark, scratch(spark), 64)
    s.upsert(_expiring(spark, d), "events")
    s.sweep_expired(NOW)
    return s.records().select("id")


@query(EXPIRING)
def recall_ttl(spark, d):
    """The guard that recall adds to its filter, over records that are not swept."""
    s = St.Store(spark, scratch(spark), 64)
    s.upsert(_expiring(spark, d), "events")
    live = s.records()
    return live.where(P.compile_filter(alive(NOW), P.bind(live))).select("id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment FROM customer WHERE c_acctbal > 5000 ORDER BY c_mktsegment DESC, c_custkey LIMIT 200")
def store_list_tagged(spark, d):
    """Listing of stored records by an attribute of the map."""
    s = St.Store(spark, scratch(spark), 64)
    c = collection(spark, d, "customer").orderBy("row")
    s.upsert(c.select("id", "c_mktsegment", "c_acctbal"), "customer")
    rows = s.records().join(c.select("id", F.col("row").alias("key")), "id").withColumn("row", F.col("key"))
    rows = rows.where(P.compile_filter(P.Gt("c_acctbal", 5000.0), P.bind(rows)))
    return P.promote(listing.list_tagged(rows, "c_mktsegment", True, 200), {"c_mktsegment": "str"}).select("id", "c_mktsegment")


@query("""
    WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
    s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, q WHERE e.label IN (1, 2))
    SELECT id, round(s, 4) AS score FROM s ORDER BY s DESC, id LIMIT 10""")
def store_search(spark, d):
    """Nearest stored records under a filter on the map of attributes."""
    s = St.Store(spark, scratch(spark), 64)
    e = collection(spark, d, "embeddings")
    s.upsert(e, "embeddings")
    got = S.search(s.records(), S.stored_vector(e, "embeddings", "0"), S.SearchOptions(where=P.In("label", [1, 2])), dimension=64)
    return got.select("id", F.round("score", 4).alias("score"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def json_round_trip(spark, d):
    """Records to JSON lines with tagged values, and back."""
    p = collection(spark, d, "part")
    made = p.select("id", P.to_attrs(p, ["p_name", "p_size", "p_retailprice"]).alias("attrs"))
    back = J.to_json(made).select(J.parse(F.col("value")).alias("r")).select("r.*")
    return shown(back, {"p_name": "str", "p_size": "int", "p_retailprice": "float"})


@query(LAST.format("true"))
def stream_upsert(spark, d):
    """Events as a stream of one-file micro-batches into a store."""
    from ..streaming.upsert import upsert_stream

    root = scratch(spark)
    St.Store(spark, root, 64)
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_id", "event_type", "value")
    # One folder of three files, by ranges of the events' numbers, so that later files hold later events.
    e.repartitionByRange(3, "event_id").write.parquet(f"{root}-in")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}-in")
    writer = upsert_stream(stream, spark, root, "users", f"events-{root[-8:]}", "event_id")
    writer.option("checkpointLocation", f"{root}-cp").trigger(availableNow=True).start().awaitTermination()
    return shown(St.Store(spark, root).records(), USER)


@query()
def remember_dedupe(spark, d):
    """All documents remembered twice: near copies go onto the first of them, and the second time each goes onto the record that is there."""
    m = Memory(St.Store(spark, scratch(spark), 64), "documents")
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    m.remember(t, NOW, dedupe_threshold=0.95)
    m.remember(t.withColumn("id", F.concat(F.lit("again-"), "id")), NOW + 1, dedupe_threshold=0.95)
    return shown(m.store.records(only=[St.CREATED, St.UPDATED]), {St.CREATED: "dt", St.UPDATED: "dt"})


@query()
def recall_chunks(spark, d):
    """Conversations remembered in chunks; the best chunk per conversation with its neighbours."""
    m = Memory(St.Store(spark, scratch(spark), 64), "talk")
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    m.remember_chunked(t.select(F.col("conv_id").cast("string").alias("id"), "text"), NOW, C.ChunkOptions("recursive", 400, 40))
    return m.recall("the and that with", NOW, S.SearchOptions(top_k=10), neighbours=1, per_parent=1).select("id", F.round("score", 6).alias("score"), "context")


__all__ = ["ORACLES", "QUERIES"]
