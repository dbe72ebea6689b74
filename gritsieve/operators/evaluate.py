"""Injection of known faults and measures of how well they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed


def seeded(seed: int, id_col: str = "id") -> Column:
    """A reproducible order of rows, the same in any engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def confusion(flagged: DataFrame, truth: DataFrame, total: int | Column | None = None) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 (and fpr with a total) of two sets of ids."""
    both = flagged.select("id", F.lit(1).alias("f")).distinct().join(truth.select("id", F.lit(1).alias("t")).distinct(), "id", "full_outer")
    n = both.agg(F.count_if(F.expr("f = 1 and t = 1")).alias("tp"), F.count_if(F.expr("f = 1 and t is null")).alias("fp"), F.count_if(F.expr("f is null and t = 1")).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    extra = [ratio(fp, F.lit(total) - tp - fn).alias("fpr")] if total is not None else []
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), *extra)


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Counts for each distinct score: the cumulative sums run over these, not over rows."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(F.expr(f"not {truth}")).alias("n"))


#: Ranges of scores whose totals are summed up in one place.
RANGES = 256


def _running(c: DataFrame) -> DataFrame:
    """(s, p, n, p_below, n_below): how many rows of either kind have a lower score, by ranges whose totals are few."""
    c = checkpointed(c)
    bounds = sorted(set(c.approxQuantile("s", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    c = c.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col("s"))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most RANGES rows
    totals = c.groupBy("_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    totals = totals.select("_range", F.sum("_p").over(before).alias("_p"), F.sum("_n").over(before).alias("_n"))
    inside = Window.partitionBy("_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda k: (F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.coalesce(f"_{k}", F.lit(0))).alias(f"{k}_below")
    return c.join(F.broadcast(totals), "_range").select("s", "p", "n", below("p"), below("n"))


def rank_auc(df: DataFrame, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row (auc): mid-ranks for ties; 0.5 with one class only."""
    c = _running(_by_score(df, truth, score))
    ranks = F.sum(F.col("p") * (F.col("p_below") + F.col("n_below") + (F.col("p") + F.col("n") + 1) / 2))
    out = c.agg(ranks.alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), auc).otherwise(0.5).alias("auc"))


def threshold_at_fpr(df: DataFrame, target: float, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row (threshold, fpr, tpr): the last point of the full ROC curve with fpr <= target; threshold null if none."""
    c = _running(_by_score(df, truth, score))
    total = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    roc = c.crossJoin(F.broadcast(total)).select("s", ((F.col("all_n") - F.col("n_below")) / F.col("all_n")).alias("fpr"), ((F.col("all_p") - F.col("p_below")) / F.col("all_p")).alias("tpr")).filter(F.col("fpr") <= target)
    return roc.agg(F.min("s").alias("threshold"), F.coalesce(F.max_by("fpr", -F.col("s")), F.lit(0.0)).alias("fpr"), F.coalesce(F.max_by("tpr", -F.col("s")), F.lit(0.0)).alias("tpr"))


def fp_rate(df: DataFrame, threshold: float, truth: str = "truth", score: str = "score") -> DataFrame:
    """One row (fp_rate): share of clean rows at or above the threshold, null without clean rows."""
    clean = F.count_if(F.expr(f"not {truth}"))
    return df.agg(F.when(clean > 0, F.count_if((~F.col(truth)) & (F.col(score) >= threshold)) / clean).alias("fp_rate"))


def first_by_hash(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """The ids of the k rows that come first by hash: whole ranges of hashes, and of one range, which is sorted, the rest."""
    hashed = rows.select("id", seeded(seed).alias("_h")).withColumn("_range", F.substring("_h", 1, 4))
    done = 0
    for r in sorted(hashed.groupBy("_range").count().collect()):  # at most 65536 ranges
        if done + r["count"] > k:
            last = hashed.filter(F.col("_range") == r["_range"]).orderBy("_h", "id").limit(k - done)
            return hashed.filter(F.col("_range") < r["_range"]).unionByName(last).select("id")
        done += r["count"]
    return hashed.select("id")


def inject_label_flips(matrix: DataFrame, fraction: float, source: int = 0, target: int = 1, seed: int = 7) -> DataFrame:
    """`matrix` with relabelled rows and is_flipped: a fraction of all rows, taken from the source class."""
    k = int(matrix.count() * fraction)
    chosen = first_by_hash(matrix.filter(F.col("label") == source), k, seed).withColumn("_flip", F.lit(True))
    flip = F.col("_flip").isNotNull() & (F.col("label") == source)
    return matrix.join(chosen, "id", "left").withColumns({"is_flipped": F.coalesce(flip, F.lit(False)), "label": F.when(flip, F.lit(target)).otherwise(F.col("label"))}).drop("_flip").select(*matrix.columns, "is_flipped")


def flip_binary(matrix: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    """`matrix` with a fraction of rows of a 0/1 labelling switched, and is_flipped."""
    flip = F.conv(F.substring(seeded(seed), 1, 8), 16, 10).cast("long") < F.lit(int(fraction * 2**32))
    return matrix.withColumn("is_flipped", flip).withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))


def inject_feature_shift(matrix: DataFrame, fraction: float, offset: float, width: int, overwrite: bool = False, seed: int = 7) -> DataFrame:
    """`matrix` with the first features of hash-chosen rows shifted (or replaced) by the offset, and is_poisoned."""
    hit = F.conv(F.substring(seeded(seed), 1, 8), 16, 10).cast("long") < F.lit(int(fraction * 2**32))
    changed = F.transform("features", lambda x, j: F.when(j < width, F.lit(float(offset)) if overwrite else x + offset).otherwise(x))
    return matrix.withColumn("is_poisoned", hit).withColumn("features", F.when(F.col("is_poisoned"), changed).otherwise(F.col("features")))


def shift_by_label(matrix: DataFrame, offset: float = 0.5) -> DataFrame:
    """Adds an offset to the feature whose index is the row's label, which gives the classes a structure."""
    return matrix.withColumn("features", F.transform("features", lambda x, j: F.when(j == F.col("label"), x + offset).otherwise(x)))


def flip_groups(matrix: DataFrame, per_class: int, rate: float, seed: int = 7) -> DataFrame:
    """(group_label, id, label, is_flipped): clean members of each class plus rows of other classes, all sources disjoint.

    Each class gives its first rows by hash to its own group and the next to the
    groups after it in turn.  ValueError if a class is too small.
    """
    poison = round(rate / (1 - rate) * per_class)
    labels = [r[0] for r in matrix.select("label").distinct().orderBy("label").collect()]  # classes are few
    share = -(-poison // max(len(labels) - 1, 1))
    need = per_class + share * (len(labels) - 1 if poison else 0)
    short = matrix.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < need).limit(1).collect()
    if short:
        raise ValueError(f"class {short[0][0]} has {short[0][1]} rows, {need} are needed")
    ranked = _ranked(matrix.select("id", "label"), need, seed).withColumnRenamed("_r", "r")
    position = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    step = F.floor((F.col("r") - per_class - 1) / max(share, 1)) + 1
    group = F.when(F.col("r") <= per_class, F.col("label")).otherwise(F.element_at(F.array(*map(F.lit, labels)), ((position + step) % len(labels) + 1).cast("int")))
    within = F.col("r") - per_class - 1
    slot = F.when(F.col("r") > per_class, (step - 1) * share + within % max(share, 1))
    out = ranked.filter(F.col("r") <= need).select(group.alias("group_label"), "id", "label", (F.col("r") > per_class).alias("is_flipped"), slot.alias("_slot"))
    return out.filter(~F.col("is_flipped") | (F.col("_slot") < poison)).drop("_slot")


def _ranked(matrix: DataFrame, k: int, seed: int) -> DataFrame:
    """The first k rows of each class by hash, numbered (_r): ranges of hashes that cannot be among them go before any sort."""
    hashed = matrix.withColumn("_h", seeded(seed)).withColumn("_range", F.substring("_h", 1, 3))
    upto = Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows of a class
    ranges = hashed.groupBy("label", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    near = hashed.join(ranges.filter(F.col("_before") < k).select("label", "_range"), ["label", "_range"], "left_semi")
    w = Window.partitionBy("label").orderBy("_h", "id")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_h", "_range")


def stratified_sample(matrix: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k rows of each class by hash order."""
    return _ranked(matrix, k, seed).drop("_r").select(*matrix.columns)


def standardize(matrix: DataFrame) -> DataFrame:
    """Zero mean and unit population variance; constant features become 0."""
    one = S.packed(S.feature_moments(matrix), "mean", "std")
    z = F.zip_with("features", "stats", lambda x, s: F.when(s["std"] > 0, (x - s["mean"]) / s["std"]).otherwise(0.0))
    return matrix.crossJoin(F.broadcast(one)).withColumn("features", z).drop("stats")


def standardize_pca(matrix: DataFrame, k: int) -> DataFrame:
    """Standardised features on their k principal axes."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = standardize(matrix).withColumn("_v", array_to_vector("features"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    return model.transform(vectors).withColumn("features", vector_to_array("_p")).drop("_v", "_p")


def compare_methods(results: DataFrame, first: str, second: str) -> DataFrame:
    """(rate, f1 of both, delta, winner) of (rate, method, f1)."""
    wide = results.groupBy("rate").pivot("method", [first, second]).agg(F.max("f1"))
    delta = F.round(F.col(first) - F.col(second), 4)
    return wide.select("rate", F.col(first).alias("f1_first"), F.col(second).alias("f1_second"), delta.alias("delta"), F.when(delta > 0, first).when(delta < 0, second).otherwise("tie").alias("winner"))


def averages(results: DataFrame) -> DataFrame:
    """(method, f1): the mean over the rates of (rate, method, f1)."""
    return results.groupBy("method").agg(F.round(F.avg("f1"), 4).alias("f1"))


def score_by_class(matrix: DataFrame, threshold: float = 3.0, forest=None) -> DataFrame:
    """(id, label, truth, score) of (id, features, label, is_flipped): rows against a baseline of their class's unflipped rows.

    The score is the largest deviation over twice the threshold, 1 at most; with a forest, its mean with the forest's.
    Classes without a baseline of two rows score 0.
    """
    from gritsieve.operators import forest as I
    from gritsieve.streaming.scoring import seed_baseline

    base = checkpointed(seed_baseline(matrix.filter("not is_flipped").withColumnRenamed("label", "key")).filter("n > 1"))
    joined = matrix.join(base, F.col("label").eqNullSafe(F.col("key")), "left")
    deviation = F.zip_with(F.zip_with("features", "mean", lambda x, m: F.abs(x - m)), F.transform("m2", lambda s: F.sqrt(s / (F.col("n") - 1))), lambda d, s: d / F.when(s > 1e-10, s).otherwise(1.0))
    scored = joined.select("id", "features", "label", F.col("is_flipped").alias("truth"), F.coalesce(F.least(F.array_max(deviation) / (2 * threshold), F.lit(1.0)), F.lit(0.0)).alias("score"))
    if forest is not None:
        raw = I.raw_scores(scored, forest)
        scored = raw.withColumn("score", (F.col("score") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - (F.col("iso_raw") - F.lit(forest.offset))))) / 2)
    return scored.select("id", "label", "truth", "score")


def score_with_feedback(matrix: DataFrame, threshold: float = 3.0, least_votes: int = 2, with_forest: bool = True, contamination: float = 0.05) -> DataFrame:
    """(id, label, truth, score, is_poisoned): each class's rows one after another, by id, through a scorer of its own.

    A scorer starts from the moments of all its class's rows, and with a forest grown from them; rows that it flags do not
    enter its moments. Rows without a label are left out.
    """
    from gritsieve.operators import forest as I
    from gritsieve.streaming import scoring as T

    rows = checkpointed(matrix.filter("label is not null").select("id", "label", "features", "is_flipped"))
    keyed = rows.select(F.col("label").cast("string").alias("key"), F.lit(None).cast("timestamp").alias("ts"), "id", "features")
    forests = {None if k is None else str(k): f for k, f in I.fit_by_class(rows.select("id", "label", "features"), contamination).items()} if with_forest else None
    scored = T.score_batch(keyed, None, checkpointed(T.seed_baseline(keyed)), forests, threshold=threshold, least_votes=least_votes)
    return scored.select("id", "score", "is_poisoned").join(rows.select("id", "label", F.col("is_flipped").alias("truth")), "id").select("id", "label", "truth", "score", "is_poisoned")


def per_class_eval(matrix: DataFrame, target: float = 0.05, threshold: float = 3.0, forest=None, digits: int = 6, scored: DataFrame | None = None) -> DataFrame:
    """(label, n, n_flipped, mean_clean, mean_flipped, auc, threshold, fpr, tpr, fp_rate): means of each class, and what the pooled scores give.

    Rows are scored by score_by_class, or come in as `scored` (label, truth, score), from score_with_feedback for one.
    """
    scored = score_by_class(matrix, threshold, forest) if scored is None else scored
    scored = checkpointed(scored.withColumn("score", F.round("score", digits)))
    at = threshold_at_fpr(scored, target)
    found = at.first()["threshold"]
    pooled = rank_auc(scored).crossJoin(at).crossJoin(fp_rate(scored, found if found is not None else float("inf")))  # one row each
    mean = lambda flipped: F.avg(F.when(F.col("truth") == flipped, F.col("score")))
    per = scored.groupBy("label").agg(F.count("*").alias("n"), F.count_if("truth").alias("n_flipped"), mean(False).alias("mean_clean"), mean(True).alias("mean_flipped"))
    return per.crossJoin(F.broadcast(pooled))


def triage_table(found: DataFrame, truth: DataFrame, top: int = 20) -> DataFrame:
    """The top rows by score with their label, threshold, truth and rank."""
    best = found.orderBy(F.desc("score"), "id").limit(top)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # over `top` rows only
    return ranked.join(truth.select("id", "is_flipped"), "id", "left").select("place", "id", "label", "score", "threshold", "flagged", "is_flipped")
