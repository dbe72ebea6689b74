"""Routing of scored rows to clean, quarantine and dead-letter destinations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def route(rows: DataFrame) -> DataFrame:
    """`rows` (error, is_poisoned, duplicate) with route: dead_letter, quarantine or clean."""
    flagged = F.coalesce(F.col("is_poisoned"), F.lit(False)) | F.coalesce(F.col("duplicate"), F.lit(False))
    return rows.withColumn("route", F.when(F.col("error").isNotNull(), "dead_letter").when(flagged, "quarantine").otherwise("clean"))


def pipeline_stats(routed: DataFrame) -> DataFrame:
    """One row: consumed, processed, quarantined, dead_lettered."""
    of = lambda r: F.count_if(F.col("route") == r)
    return routed.agg(F.count("*").alias("consumed"), (F.count("*") - of("dead_letter")).alias("processed"), of("quarantine").alias("quarantined"), of("dead_letter").alias("dead_lettered"))


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: three filtered Parquet writes in a folder for each batch, so a replay overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch).persist()
        for name in ("clean", "quarantine", "dead_letter"):
            routed.filter(F.col("route") == name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        routed.unpersist()

    return write


def quarantine_rows(rows: DataFrame) -> DataFrame:
    """(original_id, sample, source, score, ts) of the quarantined rows."""
    return route(rows).filter("route = 'quarantine'").select(F.col("id").alias("original_id"), F.to_json("features").alias("sample"), "source", "score", "ts")
