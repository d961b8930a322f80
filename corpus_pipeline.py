"""The training-data pipeline over ``documents``: each stage calls one operator of ``sextant.llm``.

Every stage works on all rows that its predecessor kept and returns the columns
of ``documents``; the last returns where each piece of a document goes. ``run``
writes each stage's result as Parquet in the shared checkpoint folder and reads
it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant import prepare
from sextant.llm import langid, linededup, mixing, packing, similar
from sextant.llm.common import checkpoint_folder, materialize
from sextant.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language is known go (null, without letters, or scored under one half)."""
    prepare(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing is left."""
    return linededup.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: 5-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return similar.drop_similar(docs, words=5, least=0.8)


def mixing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents laid out so that sources come at their target weights; none is dropped."""
    return mixing.in_mixed_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences of at most 2048 tokens, which come in mixed order."""
    prepare(spark)
    # Texts become pieces first, so that only narrow rows are ranked; their hash keeps the order of the stage before.
    rows = packing.tokenize_rows(docs.withColumn(mixing.TEXT, F.xxhash64("text")), tokenizer_path(), size=2048)
    return packing.pack_in_order(mixing.with_positions(materialize(rows)), mixing.POSITION, size=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_order),
    ("packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the fingerprints nor the packing; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
