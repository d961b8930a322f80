"""Partitioning of small inputs, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, from the session's ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-sextant-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: computed once, and kept when executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer, before work that is heavy per row.

    Only inputs of a few files are dealt anew; a large table has more partitions
    than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
