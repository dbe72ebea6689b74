"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`, and pass on any others. Empty tables give empty
results; texts of any length are handled whole; columns may have any names beside
those that a stage reads. What each stage makes of nulls, empty texts, ties and
repeated rows is said below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.llm import decontaminate, line_dedup, minhash_dedup, quality_rules, sentencepiece_codec
from gritsieve.llm.storage import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or pass a fence of their language and source go.

    Null and empty texts have no words and go; null languages and sources are groups of their own; repeated rows fare
    alike; a value at a fence stays.
    """
    return quality_rules.keep(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or nearly, in several documents or in one, the first alone stays.

    A document that loses all its lines goes, null and empty texts stay as they are. Rows without an id lose what they
    repeat themselves; rows that share an id are one document, and each keeps the lines that the id keeps.
    """
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles stays: the one with the least id.

    Null and empty texts and rows without an id are linked with nothing and stay; repeated rows stay or go together.
    """
    return minhash_dedup.dedup(docs, 5, 80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a passage at least 0.8 like one, go.

    Null and empty texts hold none and stay, null and empty items are left out; repeated rows fare alike.
    """
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with the end id, the text they decode to, and whether it is the same.

    A null text is coded as the empty one; every row gives a row.
    """
    coded = sentencepiece_codec.round_trip(docs)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same_text"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("minhash_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", tokens),
]

#: Near-duplicate lines, signatures and merges are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; their tables lie in the session's checkpoint folder, and are cleared with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
