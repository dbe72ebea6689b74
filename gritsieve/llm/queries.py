"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, license_scan, line_dedup, merkle_manifest, minhash_dedup, oracles, quality_fm, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_alignment, toxicity_cnn, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"), 24)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(_read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.find(_read(spark, sf_dir, "documents"))
    return found.drop("line", "class_id")  # told by the first document and the kept line, which do not hang on hashes


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(_read(spark, sf_dir, "documents"), 3, 85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(_read(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_decontamination": op2_decontamination,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_toxicity": op4_toxicity,
        "op5_sharding": op5_sharding,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_line_dedup": op9_line_dedup,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_warc": op12_warc,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are held against brute force, the library or held-out rows in the tests."""
    return {"op5_sharding": oracles.SHARDING, "op6_suffix_dedup": oracles.SUFFIX_DEDUP, "op8_quality_rules": oracles.QUALITY_RULES, "op9_line_dedup": oracles.LINE_DEDUP, "op10_minhash_dedup": oracles.MINHASH_DEDUP, "op11_merkle_manifest": oracles.MERKLE, "op12_warc": oracles.WARC}
