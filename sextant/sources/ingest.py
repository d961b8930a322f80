"""Directory ingestion: text files to chunked records, only what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions.text import glob_regex
from ..operators import expand as X
from ..operators.memory import Memory

HASH, PATH, CHUNKS = "mem_source_hash", "mem_source_path", "mem_source_chunks"


def read_directory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, text) of the UTF-8 files below ``root``; dot entries and other bytes are left out, and so are names that begin with an underscore, which Spark's file sources take for hidden."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # What comes before the folder, its scheme and host, has no part of the folder's own path in it.
    rel = F.substring("path", F.locate(base, F.col("path")) + F.lit(len(base)), F.length("path"))
    rows = files.select(rel.alias("path"), F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    return (rows if glob is None else rows.where(F.col("path").rlike(glob_regex(glob)))).select("path", "text")


def ingest(memory: Memory, root: str, now: int, glob: str | None = None, opts: C.ChunkOptions = C.ChunkOptions(), prune: bool = False) -> dict:
    """Chunk and store files that are new or changed; with ``prune`` forget ingested files that are gone.

    A file is unchanged if the hash of its text, the chunking options and the
    embedder stands on its first chunk and its last chunk is there. Counts of
    files written, unchanged, empty and pruned.
    """
    spark = memory.store.spark
    salt = f"{opts.mode}/{opts.max_chars}/{opts.overlap_chars}/{memory.embedder.identity}/{memory.embedder.dimension}"
    files = read_directory(spark, root, glob).withColumn("hash", F.sha2(F.concat_ws("\n", F.lit(salt), "text").cast("binary"), 256)).cache()
    stored = memory.store.records([memory.collection])
    attr = lambda k, slot: F.try_element_at("attrs", F.lit(k))[slot]
    heads = stored.where(F.col("id").endswith("#0")).select(attr(X.PARENT, "s").alias("path"), attr(HASH, "s").alias("old_hash"), attr(CHUNKS, "i").alias("n")).where("old_hash is not null")
    lasts = stored.select(F.col("id").alias("last"))
    whole = heads.join(lasts, F.concat_ws("#", "path", (F.col("n") - 1).cast("string")) == F.col("last"), "left_semi")
    changed = files.join(whole.where("n > 0"), (files["path"] == whole["path"]) & (files["hash"] == whole["old_hash"]), "left_anti")
    full = changed.where(F.trim("text") != "")
    n_chunks = F.size(C.chunks(F.col("text"), opts)).cast("long")
    rows = full.select(F.col("path").alias("id"), "text", F.col("hash").alias(HASH), F.col("path").alias(PATH), n_chunks.alias(CHUNKS))
    total, n_full = files.count(), full.count()
    empty = files.where(F.trim("text") == "").count()
    if n_full:
        memory.remember_chunked(rows, now, opts)
    pruned = 0
    if prune:
        gone = memory.store.records([memory.collection]).select("collection", "id", attr(PATH, "s").alias("path")).where("path is not null").join(files.select("path"), "path", "left_anti")
        pruned = gone.select("path").distinct().count()
        memory.store._delete(gone)
    files.unpersist()
    return {"written": n_full, "unchanged": total - n_full - empty, "empty": empty, "pruned": pruned}
