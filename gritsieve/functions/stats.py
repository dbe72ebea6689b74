"""Column and class statistics of feature matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions.ranks import percentiles


def elements(matrix: DataFrame, *keep: str) -> DataFrame:
    """(keep..., j, x): one row for each element of each vector."""
    return matrix.select(*keep, F.posexplode("features").alias("j", "x"))


def feature_moments(matrix: DataFrame) -> DataFrame:
    """(j, mean, std) with the population standard deviation."""
    return elements(matrix).groupBy("j").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def feature_quantiles(matrix: DataFrame, ps: tuple[float, ...] = (0.25, 0.5, 0.75), mode: str = "exact", accuracy: int = 10_000) -> DataFrame:
    """(j, q array<double>): linear percentiles of each feature.

    exact, bracket: found between two values of a sketch and confirmed by counts, for any number of rows: no task
    holds the values of a feature.  approx: a sketch alone.
    """
    x = elements(matrix)
    if mode == "approx":
        return x.groupBy("j").agg(F.percentile_approx("x", list(ps), accuracy).alias("q"))
    if mode not in ("exact", "bracket"):
        raise ValueError(mode)
    return percentiles(x, ["j"], ps, accuracy).select("j", "q")


def packed(stats: DataFrame, *fields: str) -> DataFrame:
    """All features' statistics as one row (stats array<struct>), in feature order."""
    return stats.agg(F.array_sort(F.collect_list(F.struct("j", *fields))).alias("stats"))


def class_centroids(matrix: DataFrame) -> DataFrame:
    """(label, centroid): the coordinate-wise median of each class, of any size."""
    per = percentiles(elements(matrix, "label"), ["label", "j"], (0.5,)).select("label", "j", F.col("q")[0].alias("m"))
    return per.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("centroid"))


def class_means(matrix: DataFrame) -> DataFrame:
    """(label, n, center): class sizes and mean vectors."""
    per = elements(matrix, "label").groupBy("label", "j").agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    return per.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("center"))


def class_scatter(matrix: DataFrame, centers: DataFrame) -> DataFrame:
    """(label, n, gram): sums of outer products of rows about their class centre, gram flattened to d*d.

    Rows are centred first, so nothing cancels; each task adds up one matrix per
    class before anything is shuffled.
    """
    centred = matrix.join(F.broadcast(centers.select("label", F.col(centers.columns[-1]).alias("_c"))), "label").select("label", F.zip_with("features", "_c", lambda x, c: x - c).alias("v"))
    kind = centred.schema["label"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for label, part in pdf.groupby("label"):
                v = np.stack(part["v"].to_numpy())
                n, g = sums.get(label, (0, 0.0))
                sums[label] = (n + len(v), g + v.T @ v)
        yield pd.DataFrame([(k, n, g.ravel()) for k, (n, g) in sums.items()], columns=["label", "n", "gram"])

    parts = centred.mapInPandas(partial, f"label {kind}, n bigint, gram array<double>")
    cells = parts.select("label", "n", F.posexplode("gram").alias("at", "g")).groupBy("label", "at").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return cells.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda s: s["g"]).alias("gram"))


def running_moments(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """`df` with count, mean and sample deviation of the key's earlier values (0 deviation below two)."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        "n_before": F.count(value).over(before),
        "mean_before": F.coalesce(F.avg(value).over(before), F.lit(0.0)),
        "std_before": F.coalesce(F.stddev_samp(value).over(before), F.lit(0.0)),
    })


def half_even(x: Column, digits: int) -> Column:
    """Rounding half to even, without a negative zero."""
    return F.bround(x, digits) + F.lit(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
