"""Reports of per-sample results as rows, JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def summary(rows: DataFrame, methods: dict[str, str]) -> DataFrame:
    """(item, value): total, flagged, rate in percent (none for no rows) and flags of each method by name."""
    n, bad = F.count("*"), F.count_if("is_poisoned")
    items = [F.struct(F.lit("total").alias("item"), n.cast("double").alias("value")), F.struct(F.lit("flagged").alias("item"), bad.cast("double").alias("value")), F.struct(F.lit("rate_percent").alias("item"), F.when(n > 0, F.round(100.0 * bad / n, 2)).alias("value"))]
    items += [F.struct(F.lit(f"method:{m}").alias("item"), F.count_if(c).cast("double").alias("value")) for m, c in sorted(methods.items())]
    return rows.agg(F.array(*items).alias("i")).select(F.explode("i").alias("i")).select("i.item", "i.value").filter("value is not null")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): one object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def as_csv(rows: DataFrame) -> DataFrame:
    """(sample_idx, score, is_poisoned) with six decimals."""
    return rows.select(F.col("id").alias("sample_idx"), F.format_string("%.6f", "anomaly_score").alias("score"), "is_poisoned")


def write(rows: DataFrame, path: str, fmt: str) -> None:
    """Per-sample rows as JSON or CSV files."""
    if fmt == "csv":
        as_csv(rows).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def attribution_rows(attributed: DataFrame, names: list[str] | None = None, digits: int = 4) -> DataFrame:
    """(id, place, feature, deviation) with four decimals by default; unnamed features are called feature_j."""
    named = F.get(F.array(*map(F.lit, names)), F.col("j")) if names else F.lit(None).cast("string")
    exploded = attributed.select("id", F.posexplode(F.arrays_zip("features_flagged", "deviations")).alias("place", "p")).select("id", "place", F.col("p.features_flagged").alias("j"), F.col("p.deviations").alias("d"))
    return exploded.select("id", "place", F.coalesce(named, F.concat(F.lit("feature_"), F.col("j"))).alias("feature"), F.round("d", digits).alias("deviation"))
