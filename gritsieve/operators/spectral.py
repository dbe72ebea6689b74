"""Label-flip detectors: per-class spectral scores and centroid distances.

The singular vectors of a class come from its scatter matrix (d x d), summed
over partitions and decomposed once per class; rows are only ever projected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed
from gritsieve.functions.ranks import percentiles, ranked

LEAST_CLASS = 5


def _directions(matrix: DataFrame, centers: DataFrame, k: int, whiten: bool, ridge: float) -> DataFrame:
    """(label, n, center, axes): top-k eigenvectors of each class, scaled for whitening if asked."""
    scatter = S.class_scatter(matrix, centers)
    kind = scatter.schema["label"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, n, gram in pdf[["label", "n", "gram"]].itertuples(index=False):
            d = int(round(len(gram) ** 0.5))
            values, vectors = np.linalg.eigh(np.asarray(gram, float).reshape(d, d))
            top = min(k, n, d)
            axes = vectors[:, ::-1][:, :top].T
            if whiten:
                s = np.sqrt(np.maximum(values[::-1][:top], 0.0))
                axes = axes / (s / np.sqrt(max(n - 1, 1)) + ridge)[:, None]
            out.append((label, n, [list(map(float, a)) for a in axes]))
        return pd.DataFrame(out, columns=["label", "n", "axes"])

    axes = scatter.groupBy("label").applyInPandas(solve, f"label {kind}, n bigint, axes array<array<double>>")
    return axes.join(centers.select("label", F.col(centers.columns[-1]).alias("center")), "label")


def _projected(matrix: DataFrame, axes: DataFrame) -> DataFrame:
    """(id, label, n, score): norm of each row's projection on its class's axes; classes number few, so they are broadcast."""
    v = F.zip_with("features", "center", lambda x, c: x - c)
    joined = matrix.join(F.broadcast(axes), "label").select("id", "label", "n", "axes", v.alias("_v"))
    return joined.select("id", "label", "n", S.norm(F.transform("axes", lambda a: S.dot(a, F.col("_v")))).alias("score"))


def spectral_scores(matrix: DataFrame, n_components: int = 1, min_class_size: int = LEAST_CLASS) -> DataFrame:
    """Scores about the class mean; classes below the least size give no rows."""
    centers = checkpointed(S.class_means(matrix).filter(F.col("n") >= min_class_size))  # a vector for each class, read three times
    return _projected(matrix, _directions(matrix, centers, n_components, False, 0.0))


def spectral_detect(matrix: DataFrame, n_components: int = 1, iqr_multiplier: float = 1.5, min_class_size: int = LEAST_CLASS) -> DataFrame:
    """(id, label, score, threshold, flagged, rank): flagged iff the score passes q3 + m * iqr of its class."""
    scored = checkpointed(spectral_scores(matrix, n_components, min_class_size))
    q = quantiles_by_class(scored, (0.25, 0.75))
    q = q.select("label", (F.col("q")[1] + iqr_multiplier * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))
    out = scored.join(F.broadcast(q), "label").withColumn("flagged", F.col("score") > F.col("threshold"))
    return by_score(out.select("id", "label", "score", "threshold", "flagged"))


def quantiles_by_class(scored: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """(label, n, q) of (label, score): a class of any size, a row for each."""
    return percentiles(scored.select("label", F.col("score").alias("x")), ["label"], ps)


def by_score(scored: DataFrame) -> DataFrame:
    """Rows with their rank in their class, the largest score first, the lesser id first among equals."""
    return ranked(scored, "label", [F.desc("score"), F.col("id")])


def class_stats(matrix: DataFrame, found: DataFrame, min_class_size: int = LEAST_CLASS) -> DataFrame:
    """(label, n, n_flagged, threshold, q1, q3, iqr, mean_score, max_score, singular_value, explained, skipped, reason) of every class.

    singular_value is the largest of the class's rows about their mean, explained its square's share of all.
    """
    sizes = matrix.groupBy("label").agg(F.count("*").alias("n"))
    flags = found.groupBy("label").agg(F.count_if("flagged").alias("n_flagged"), F.max("threshold").alias("threshold"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    flags = flags.join(quantiles_by_class(found, (0.25, 0.75)).select("label", F.col("q").alias("_q")), "label")
    centers = S.class_means(matrix).filter(F.col("n") >= min_class_size)
    scatter = S.class_scatter(matrix, centers)
    kind = scatter.schema["label"].dataType.simpleString()

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, gram in pdf[["label", "gram"]].itertuples(index=False):
            d = int(round(len(gram) ** 0.5))
            values = np.maximum(np.linalg.eigvalsh(np.asarray(gram, float).reshape(d, d)), 0.0)
            out.append((label, float(np.sqrt(values[-1])), float(values[-1] / values.sum()) if values.sum() > 0 else 0.0))
        return pd.DataFrame(out, columns=["label", "singular_value", "explained"])

    spectra = scatter.groupBy("label").applyInPandas(spectrum, f"label {kind}, singular_value double, explained double")
    skipped = F.col("n") < min_class_size
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return sizes.join(flags, "label", "left").join(spectra, "label", "left").select("label", "n", F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), "threshold", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"), "mean_score", "max_score", "singular_value", "explained", skipped.alias("skipped"), F.when(skipped, F.lit("too few samples")).alias("reason"))


def label_flips_topk(matrix: DataFrame, contamination: float = 0.05, n_components: int = 1) -> DataFrame:
    """As spectral_detect, with the (1 - contamination) percentile of the class as threshold."""
    scored = checkpointed(spectral_scores(matrix, n_components))
    q = quantiles_by_class(scored, (1.0 - contamination,)).select("label", F.col("q")[0].alias("threshold"))
    return scored.join(F.broadcast(q), "label").select("id", "label", "score", "threshold", (F.col("score") > F.col("threshold")).alias("flagged"))


def label_flips_crossclass(matrix: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Distance to the own class's median less that to the nearest other; the top share of each class is flagged.

    Small classes are not scored but still count as others; with one class there are no rows.
    """
    centroids = S.class_centroids(matrix).agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    sizes = matrix.groupBy("label").agg(F.count("*").alias("n"))
    distance = F.transform("all", lambda c: F.struct(c["label"].alias("label"), S.norm(F.zip_with("features", c["centroid"], lambda x, m: x - m)).alias("d")))
    rows = matrix.crossJoin(F.broadcast(centroids)).select("id", "label", distance.alias("ds"))  # one row of classes x d numbers
    own = F.array_max(F.transform(F.filter("ds", lambda s: s["label"] == F.col("label")), lambda s: s["d"]))
    other = F.array_min(F.transform(F.filter("ds", lambda s: s["label"] != F.col("label")), lambda s: s["d"]))
    scored = rows.select("id", "label", (own - other).alias("score")).filter("score is not null").join(F.broadcast(sizes.filter(F.col("n") >= LEAST_CLASS)), "label")
    budget = F.greatest(F.lit(1), F.bround(F.col("n") * contamination, 0).cast("int"))
    return by_score(scored.select("id", "label", "score", budget.alias("_budget"))).select("id", "label", "score", "rank", (F.col("rank") <= F.col("_budget")).alias("flagged"))


def label_flips_robust(matrix: DataFrame, contamination: float = 0.05, n_components: int = 8, ridge: float = 1e-3) -> DataFrame:
    """Whitened distance about the class median in the top subspace; each class has its share of the whole budget."""
    sizes = matrix.groupBy("label").agg(F.count("*").alias("n"))
    kept = sizes.filter(F.col("n") >= LEAST_CLASS).select("label")
    centers = checkpointed(S.class_centroids(matrix).join(kept, "label"))
    scored = _projected(matrix, _directions(matrix, centers, n_components, True, ridge))
    total = sizes.agg(F.sum("n").alias("total"))
    whole = F.greatest(F.lit(1), F.bround(contamination * F.col("total"), 0))
    budget = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(whole * F.col("n") / F.col("total"), 0)))
    scored = by_score(scored.crossJoin(F.broadcast(total)).select("id", "label", "score", budget.alias("_budget")))
    return scored.select("id", "label", "score", "rank", (F.col("rank") <= F.col("_budget")).alias("flagged"))
