"""Streams into and out of a store.

A micro-batch is one commit. The manifest remembers each stream's last batch, so
a batch that is replayed after a failure is passed over: upserts are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import STORED, Conflict, Store


def upsert_stream(records: DataFrame, spark: SparkSession, root: str, collection: str, name: str, order_by: str | None = None, deletes: str | None = None) -> DataStreamWriter:
    """A writer that upserts a stream of records (id, ...) into a collection.

    ``order_by`` decides which of a key's records in one micro-batch is the last;
    rows where the boolean column ``deletes`` holds delete their key. Start it
    with a checkpoint location of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = Store(spark, root)
        for _ in range(10):
            store.refresh()
            if store.manifest["streams"].get(name, -1) >= number:
                return
            rows = batch
            if order_by is not None:
                rows = rows.groupBy("id").agg(F.max_by(F.struct("*"), order_by).alias("r")).select("r.*")
            gone = rows.where(F.col(deletes)).select(F.lit(collection).alias("collection"), "id") if deletes else None
            rows = rows.where(~F.col(deletes)).drop(deletes) if deletes else rows
            try:
                with store.group():  # deletes and upserts are one version
                    if gone is not None:
                        store._delete(gone.join(store.records([collection]).select("id"), "id", "left_semi"))
                    store.upsert(rows, collection, streams={**store.manifest["streams"], name: number})
                return
            except Conflict:
                continue  # another writer was first: go on from its version
        raise Conflict("too many writers")

    return records.writeStream.queryName(name).foreachBatch(write)


def operations_stream(spark: SparkSession, root: str) -> DataFrame:
    """All operations that are written to a store, as a stream; a batch may arrive before its manifest is published."""
    return spark.readStream.schema(STORED).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/ops")


def drop_repeats(records: DataFrame, time: str, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark, for sources that deliver more than once."""
    return records.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)
