"""One query per training-data operator over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, langid, licenses, linededup, mixing, packing, quality, secretscan, simhash, toxicity
from .common import read_documents, spread


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(read_documents(spark, sf_dir)), words=4, max_bits=4)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spread(read_documents(spark, sf_dir)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicate(read_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(spread(read_documents(spark, sf_dir)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spread(read_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edited(spread(read_documents(spark, sf_dir)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(read_documents(spark, sf_dir)))


def tokenizer_path() -> str:
    """Where the installed public vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read_documents(spark, sf_dir)), tokenizer_path(), size=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_license_scan, op3_line_dedup, op4_secret_scan, op5_source_mixing, op6_quality_rules, op7_toxicity_neighbours, op8_weighted_fingerprints, op9_language_id, op10_best_fit_packing)
}
ORACLES: dict[str, str] = {}
