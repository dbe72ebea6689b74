"""Names of the registered queries, their functions and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gritsieve.plans import batch, frames, monitoring, sequences, streams

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return batch.QUERIES | sequences.QUERIES | monitoring.QUERIES | streams.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-score and IQR votes of `lineitem` with the most deviant features, as report rows."""
    from gritsieve.operators import detect
    from gritsieve.plans import reports
    from gritsieve.sources import features

    matrix = features.validate(frames.lineitem(spark, sf_dir))
    rows = detect.decide(detect.screen(matrix), ["z_vote", "iqr_vote"], 1)
    return reports.summary(rows, {"zscore": "z_vote", "iqr": "iqr_vote"})
