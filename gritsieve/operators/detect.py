"""Batch detectors over a feature matrix: z-score, IQR fences, votes, attribution and the dispatcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed
from gritsieve.sources import features as src


def z_score(row_stats: str = "stats") -> Column:
    """Largest |x - mean| / std over the features that vary; 0 if none does."""
    each = F.zip_with("features", row_stats, lambda x, s: F.when(s["std"] > 0, F.abs(x - s["mean"]) / s["std"]))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def iqr_score(k: float, row_stats: str = "stats") -> Column:
    """Largest distance outside the fences in units of the IQR; 0 inside, constant features skipped."""

    def outside(x: Column, s: Column) -> Column:
        q1, q3 = s["q"][0], s["q"][1]
        iqr = q3 - q1
        low, high = q1 - k * iqr, q3 + k * iqr
        return F.when(iqr > 0, F.when(x < low, (low - x) / iqr).when(x > high, (x - high) / iqr).otherwise(0.0))

    return F.coalesce(F.array_max(F.zip_with("features", row_stats, outside)), F.lit(0.0))


def beside(matrix: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row beside one row of statistics, O(features) in size."""
    return matrix.crossJoin(F.broadcast(one_row))


def zscore_detect(matrix: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(id, score, flagged): flagged iff the score reaches the threshold."""
    score = beside(matrix, S.packed(S.feature_moments(matrix), "mean", "std")).select("id", z_score().alias("score"))
    return score.withColumn("flagged", F.col("score") >= threshold)


def iqr_detect(matrix: DataFrame, k: float = 1.5, mode: str = "exact") -> DataFrame:
    """(id, score, flagged): flagged iff a feature lies strictly outside its fences."""
    quartiles = S.packed(S.feature_quantiles(matrix, (0.25, 0.75), mode), "q")
    score = beside(matrix, quartiles).select("id", iqr_score(k).alias("score"))
    return score.withColumn("flagged", F.col("score") > 0)


def attribution(matrix: DataFrame, top: int | None = 3) -> DataFrame:
    """(id, features_flagged, deviations): features by |x - overall mean|, the lower index first among equals."""
    means = S.packed(S.feature_moments(matrix), "mean")
    return beside(matrix, means).select("id", *ranked_deviations(top))


def ranked_deviations(top: int | None) -> list[Column]:
    pairs = F.array_sort(F.transform(F.zip_with("features", "stats", lambda x, s: -F.abs(x - s["mean"])), lambda d, j: F.struct(d.alias("d"), j.alias("j"))))
    pairs = F.slice(pairs, 1, top) if top else pairs
    return [F.transform(pairs, lambda p: p["j"]).alias("features_flagged"), F.transform(pairs, lambda p: -p["d"]).alias("deviations")]


def statistics(matrix: DataFrame, mode: str = "exact") -> DataFrame:
    """One row of moments and quartiles of all features, for every per-row score."""
    both = S.feature_moments(matrix).join(S.feature_quantiles(matrix, (0.25, 0.75), mode), "j")
    return S.packed(both, "mean", "std", "q")


def with_votes(rows: DataFrame, stats: DataFrame, z_threshold: float = 3.0, k: float = 1.5) -> DataFrame:
    """`rows` beside the statistics, with both scores and votes."""
    scored = beside(rows, stats).withColumns({"z_score": z_score(), "iqr_score": iqr_score(k)})
    return scored.withColumns({"z_vote": F.col("z_score") >= z_threshold, "iqr_vote": F.col("iqr_score") > 0})


def votes(matrix: DataFrame, z_threshold: float = 3.0, k: float = 1.5, mode: str = "exact") -> DataFrame:
    """Z-score and IQR in one projection over one row of statistics: (id, features, stats, z, iqr, votes)."""
    return with_votes(matrix.select("id", "features"), statistics(matrix, mode), z_threshold, k)


def screen(matrix: DataFrame, z_threshold: float = 3.0, k: float = 1.5) -> DataFrame:
    """Z-score and IQR votes with the three most deviant features of flagged rows."""
    v = votes(matrix, z_threshold, k)
    flagged = F.col("z_vote") | F.col("iqr_vote")
    top, _ = ranked_deviations(3)
    return v.select("id", "z_score", "iqr_score", "z_vote", "iqr_vote", F.when(flagged, top).alias("features_flagged"), (F.col("z_vote").cast("int") + F.col("iqr_vote").cast("int")).alias("votes"))


def ensemble_vote(matrix: DataFrame, contamination: float = 0.1, seed: int = 42, mode: str = "bracket") -> DataFrame:
    """Majority of z-score, IQR and isolation forest; anomaly_score is the forest's.

    The statistics are found once and written, one row; the forest is fitted on the matrix alone, and its scores are
    written with the rows, over which everything else is one projection.
    """
    from gritsieve.operators import forest as I

    rows = matrix.select("id", "features")
    stats = checkpointed(statistics(rows, mode))
    forest, raw = I.fit_and_score(rows, contamination, seed)
    scored = with_votes(I.judged(raw, forest.offset, forest.ends), stats)
    n = F.col("z_vote").cast("int") + F.col("iqr_vote").cast("int") + F.col("iso_vote").cast("int")
    poisoned = n >= 2
    top, _ = ranked_deviations(3)
    return scored.select("id", F.col("iso_score").alias("anomaly_score"), F.lit("ensemble").alias("method"), F.when(poisoned, top).otherwise(F.array().cast("array<int>")).alias("features_flagged"), poisoned.alias("is_poisoned"), "z_vote", "iqr_vote", "iso_vote")


def decide(votes_df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Vote arithmetic over given boolean columns: adds votes and is_poisoned."""
    n = sum((F.col(c).cast("int") for c in columns), F.lit(0))
    return votes_df.withColumn("votes", n).withColumn("is_poisoned", F.col("votes") >= least)


def detect(matrix: DataFrame, method: str = "ensemble", **options) -> tuple[DataFrame, DataFrame]:
    """(per-sample rows, summary row) of a method: zscore, iqr, isolation, ensemble, spectral, topk, crossclass or robust.

    The matrix is validated first (ValueError for rows that are not finite, ragged or too few) unless strict=False.
    """
    from gritsieve.operators import forest as I, spectral as P

    none = F.array().cast("array<int>")
    labelled = method in ("spectral", "topk", "crossclass", "robust")
    if options.pop("strict", True):
        src.validate(matrix, 1 if method in ("zscore", "iqr") else 2, labelled)
    if method in ("zscore", "iqr"):
        k, mode, least = options.pop("k", 1.5), options.pop("mode", "exact"), options.pop("threshold", 3.0)
        if options:
            raise ValueError(f"unknown options {sorted(options)}")
        own = S.feature_moments(matrix)
        if method == "iqr":
            own = own.join(S.feature_quantiles(matrix, (0.25, 0.75), mode), "j")
        rows = beside(matrix, S.packed(own, "mean", "std", *(["q"] if method == "iqr" else [])))
        rows = rows.withColumn("score", z_score() if method == "zscore" else iqr_score(k))
        flagged = F.col("score") >= least if method == "zscore" else F.col("score") > 0
        top, _ = ranked_deviations(3)
        rows = rows.select("id", F.when(flagged, F.col("score")).otherwise(0.0).alias("anomaly_score"), F.lit(method).alias("method"), F.when(flagged, top).otherwise(none).alias("features_flagged"), flagged.alias("is_poisoned"))
        counts = [method]
    elif method == "isolation":
        scored = I.trained(matrix, **options)
        rows = scored.select("id", F.col("iso_score").alias("anomaly_score"), F.lit(method).alias("method"), none.alias("features_flagged"), F.col("iso_vote").alias("is_poisoned"))
        counts = [method]
    elif method == "ensemble":
        rows = ensemble_vote(matrix, **options)
        counts = ["zscore", "iqr", "isolation"]
    elif labelled:
        run = {"spectral": P.spectral_detect, "topk": P.label_flips_topk, "crossclass": P.label_flips_crossclass, "robust": P.label_flips_robust}[method]
        rows = run(matrix, **options).select("id", F.col("score").alias("anomaly_score"), F.lit(method).alias("method"), none.alias("features_flagged"), F.col("flagged").alias("is_poisoned"))
        counts = [method]
    else:
        raise ValueError(f"unknown method {method}")
    names = {"zscore": "z_vote", "iqr": "iqr_vote", "isolation": "iso_vote"} if method == "ensemble" else {counts[0]: "is_poisoned"}
    summary = rows.agg(F.count("*").alias("total_samples"), F.count_if("is_poisoned").alias("poisoned_count"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.count_if(c).cast("double") for c in names.values()])).alias("method_scores"))
    return rows.select("id", "anomaly_score", "method", "features_flagged", "is_poisoned"), summary


def scan_table(df: DataFrame, id_col: str, label_col: str | None = None, listed: int = 50) -> DataFrame:
    """One row: verdict, counts and the first flagged ids of a labelled wide table, by the spectral detector."""
    from gritsieve.operators import spectral as P

    spark = df.sparkSession
    try:
        matrix = checkpointed(src.infer_features(df, id_col, label_col))  # packed once, read several times
    except ValueError as e:
        return spark.createDataFrame([("ERROR", str(e), 0, 0, [])], "verdict string, reason string, n_rows bigint, n_flagged bigint, flagged_ids array<string>")
    return scan_verdict(P.spectral_detect(matrix), matrix, listed)


def scan_verdict(found: DataFrame, matrix: DataFrame, listed: int = 50) -> DataFrame:
    """The scan's summary over given flags."""
    n = matrix.agg(F.count("*").alias("n_rows"))
    first = found.filter("flagged").select("id").orderBy("id").limit(listed).agg(F.array_sort(F.collect_list(F.col("id"))).alias("ids"))
    flagged = found.agg(F.count_if("flagged").alias("n_flagged"))
    verdict = F.when(F.col("n_rows") == 0, "ERROR").when(F.col("n_flagged") > 0, "POISON_SUSPECTED").otherwise("clean")
    return n.crossJoin(flagged).crossJoin(first).select(verdict.alias("verdict"), F.when(F.col("n_rows") == 0, "no rows").alias("reason"), "n_rows", "n_flagged", F.transform("ids", lambda i: i.cast("string")).alias("flagged_ids"))
