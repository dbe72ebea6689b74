"""Quarantine log and its review, as an append-only table plus resolution events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STATUSES = ("pending", "confirmed_poison", "false_positive", "released")


def append(samples: DataFrame) -> DataFrame:
    """Log rows (sample_id, sample_data, scores, ts, source, status) of (id, features, scores, ts, source).

    The id is a hash of what is stored, so replaying a batch repeats no row's identity.
    """
    payload = F.to_json("features")
    return samples.select(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("source"))).alias("sample_id"), F.col("id").alias("original_id"), payload.alias("sample_data"), "scores", F.coalesce("ts", F.current_timestamp()).alias("ts"), "source", F.lit("pending").alias("status"))


def latest(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Each sample in its present state: the newest resolution (sample_id, status, reviewer, notes, resolved_at) wins."""
    w = Window.partitionBy("sample_id").orderBy(F.desc("resolved_at"), F.desc("status"))
    newest = resolutions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("sample_id", F.col("status").alias("_status"), "reviewer", "notes")
    return log.join(newest, "sample_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def get(current: DataFrame, sample_id: str) -> DataFrame:
    return current.filter(F.col("sample_id") == sample_id)


def pending(current: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest pending samples."""
    return current.filter("status = 'pending'").orderBy("ts", "sample_id").limit(limit)


def unknown_resolutions(log: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions of ids that the log does not hold."""
    return resolutions.join(log.select("sample_id").distinct(), "sample_id", "left_anti")


def stats(current: DataFrame) -> DataFrame:
    """One row: total, pending, confirmed, false positives, oldest pending ('' if none)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    oldest = F.min(F.when(F.col("status") == "pending", F.col("ts")))
    return current.agg(F.count("*").alias("total"), is_("pending").alias("pending"), is_("confirmed_poison").alias("confirmed"), is_("false_positive").alias("false_positives"), F.coalesce(F.date_format(oldest, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("oldest_pending"))
