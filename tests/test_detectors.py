"""Detectors against independent restatements on small seeded matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.functions import stats as S
from gritsieve.operators import detect as D, duplicates as U, evaluate as E, forest as I, spectral as P
from gritsieve.sources import features as src


def frame(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], *([int(labels[i])] if labels is not None else [])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>" + (", label int" if labels is not None else ""))


def flagged(df):
    return {r["id"] for r in df.filter("flagged").collect()}


def two_classes(shift=5.0, n=200, d=10, flips=5):
    rng = np.random.default_rng(1)
    y = np.repeat([0, 1], n // 2)
    x = rng.normal(0, 1, (n, d)) + shift * y[:, None]
    y[:flips] = 1
    return x, y


def test_zscore_and_constant_columns(spark):
    x = np.vstack([np.ones((99, 2)), [[500.0, 500.0]]])
    assert flagged(D.zscore_detect(frame(spark, x))) == {99}
    assert flagged(D.zscore_detect(frame(spark, np.ones((10, 2))))) == set()


def test_iqr_is_monotone_in_k(spark):
    x = np.r_[np.arange(100.0), 200, 250][:, None]
    narrow, wide = (flagged(D.iqr_detect(frame(spark, x), k)) for k in (1.5, 3.0))
    assert wide <= narrow and 101 in narrow


def test_quantiles_agree_in_all_exact_modes(spark):
    x = np.random.default_rng(3).normal(size=(500, 3))
    m = frame(spark, x)
    want = np.quantile(x, [0.25, 0.5, 0.75], axis=0).T
    for mode in ("exact", "bracket"):
        got = {r["j"]: r["q"] for r in S.feature_quantiles(m, mode=mode).collect()}
        assert np.allclose([got[j] for j in range(3)], want, atol=1e-12)


def test_results_do_not_depend_on_partitioning(spark):
    m = frame(spark, np.random.default_rng(5).normal(size=(300, 4)))
    a = {r["id"]: (r["anomaly_score"], r["is_poisoned"]) for r in D.ensemble_vote(m.repartition(1)).collect()}
    b = {r["id"]: (r["anomaly_score"], r["is_poisoned"]) for r in D.ensemble_vote(m.repartition(7)).collect()}
    assert a == b


def test_forest_separates_outliers_and_respects_contamination(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (95, 2)), rng.uniform(50, 70, (5, 2))])
    m = frame(spark, x)
    scored = {r["id"]: r for r in I.score(m, I.fit(m)).collect()}
    assert all(scored[i]["iso_score"] > 0.5 for i in range(95, 100))
    few, many = (I.score(m, I.fit(m, c)).filter("iso_vote").count() for c in (0.05, 0.2))
    assert few < many
    flat = frame(spark, np.ones((20, 2)))
    assert {r["iso_score"] for r in I.score(flat, I.fit(flat)).collect()} == {0.5}


def test_spectral_scores_equal_svd(spark):
    x, y = two_classes()
    got = {r["id"]: r["score"] for r in P.spectral_scores(frame(spark, x, y), 2).collect()}
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        c = x[own] - x[own].mean(0)
        v = np.linalg.svd(c, full_matrices=False)[2][:2]
        assert np.allclose([got[i] for i in own], np.linalg.norm(c @ v.T, axis=1), atol=1e-9)


def test_robust_scores_equal_svd(spark):
    x, y = two_classes(d=6)
    found = P.label_flips_robust(frame(spark, x, y), n_components=3)
    got = {r["id"]: r["score"] for r in found.collect()}
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        c = x[own] - np.median(x[own], axis=0)
        _, s, v = np.linalg.svd(c, full_matrices=False)
        w = (c @ v[:3].T) / (s[:3] / np.sqrt(len(own) - 1) + 1e-3)
        assert np.allclose([got[i] for i in own], np.linalg.norm(w, axis=1), atol=1e-8)


def test_flips_are_found_and_small_classes_skipped(spark):
    x, y = two_classes()
    m = frame(spark, x, y)
    assert len(flagged(P.label_flips_crossclass(m)) & set(range(5))) >= 2
    y2 = y.copy()
    y2[:] = 0
    y2[:3] = 1
    found = P.spectral_detect(frame(spark, x, y2))
    assert {r["label"] for r in found.select("label").distinct().collect()} == {0}
    stats = {r["label"]: r["skipped"] for r in P.class_stats(frame(spark, x, y2), found).collect()}
    assert stats == {0: False, 1: True}
    assert P.label_flips_crossclass(frame(spark, x, np.zeros(len(x)))).count() == 0


def test_violations(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [float("nan"), 1.0]), (3, []), (4, None), (5, [float("inf"), 2.0])]
    got = {(r["id"], r["feature_idx"], r["reason"]) for r in src.violations(spark.createDataFrame(rows, "id int, features array<double>")).collect()}
    assert got == {(1, None, "ragged"), (2, 0, "not_finite"), (3, None, "zero_width"), (4, None, "zero_width"), (5, 0, "not_finite")}
    with pytest.raises(ValueError):
        src.validate(spark.createDataFrame([], "id int, features array<double>"))


def test_detect_dispatch(spark):
    x, y = two_classes()
    m = frame(spark, x, y)
    for method in ("zscore", "iqr", "isolation", "ensemble", "spectral", "topk", "crossclass", "robust"):
        rows, summary = D.detect(m, method)
        s = summary.first()
        assert s["total_samples"] == 200 and s["poisoned_count"] == rows.filter("is_poisoned").count()
    with pytest.raises(ValueError):
        D.detect(m, "nothing")


def test_auc_handles_ties(spark):
    rows = [(i, float(s), bool(t)) for i, (s, t) in enumerate([(1, 0), (1, 1), (2, 1), (0, 0)])]
    df = spark.createDataFrame(rows, "id int, score double, truth boolean")
    assert E.rank_auc(df).first()["auc"] == pytest.approx(0.875)
    assert E.rank_auc(df.filter("truth")).first()["auc"] == 0.5


def test_flip_groups_are_disjoint(spark):
    x, y = two_classes(flips=0)
    out = E.flip_groups(frame(spark, x, y), 20, 0.25)
    assert out.count() == out.select("id").distinct().count() == 54
    with pytest.raises(ValueError):
        E.flip_groups(frame(spark, x, y), 1000, 0.25)


@pytest.fixture(scope="module")
def flip_benchmark(spark):
    """2000 rows of 100 features in two classes: 20 informative features in two clusters a class, 5 that depend on them, 75 of noise."""
    rng = np.random.default_rng(42)
    rows, mixing = [], rng.uniform(-1, 1, (20, 5))
    for label in (0, 1):
        for _ in range(2):
            centre, shape = rng.choice([-2.0, 2.0], 20), rng.uniform(-1, 1, (20, 20))
            told = rng.normal(size=(500, 20)) @ shape + centre
            rows += [(label, x.tolist()) for x in np.hstack([told, told @ mixing, rng.normal(size=(500, 75))])]
    return spark.createDataFrame([(i, x, y) for i, (y, x) in enumerate(rows)], "id bigint, features array<double>, label int").repartition(4).cache()


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2])
def test_crossclass_beats_the_others_on_flips(flip_benchmark, rate):
    m = E.inject_label_flips(flip_benchmark, rate).cache()
    truth = m.filter("is_flipped")
    f1 = lambda flagged: E.confusion(flagged, truth).first()["f1"]
    own, top = (f1(run(m, rate).filter("flagged")) for run in (P.label_flips_crossclass, P.label_flips_topk))
    assert truth.count() == 2000 * rate and own > top and own > 0.4
    if rate == 0.1:
        assert own > f1(D.ensemble_vote(m).filter("is_poisoned"))


def test_detect_validates(spark, flip_benchmark):
    bad = flip_benchmark.limit(100).withColumn("features", F.when(F.col("id") % 10 == 0, F.array(F.lit(float("nan")))).otherwise(F.col("features")))
    for method in ("zscore", "iqr", "crossclass"):
        with pytest.raises(ValueError):
            D.detect(bad, method)


def test_ranges_of_scores_and_hashes(spark, monkeypatch):
    """AUC, threshold and choices by hash over many ranges against plain sorts."""
    rng = np.random.default_rng(5)
    rows = [(i, bool(rng.random() < 0.3), float(np.round(rng.normal() + 0.0, 2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, truth boolean, score double").repartition(5)
    bad, good = (np.array([s for _, t, s in rows if t == v]) for v in (True, False))
    wins = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    assert E.rank_auc(df).first()["auc"] == pytest.approx(wins)
    r = E.threshold_at_fpr(df, 0.1).first()
    best = min(s for s in {s for *_, s in rows} if (good >= s).mean() <= 0.1)
    assert (r["threshold"], r["fpr"], r["tpr"]) == pytest.approx((best, (good >= best).mean(), (bad >= best).mean()))
    by_hash = [r["id"] for r in df.orderBy(E.seeded(7), "id").collect()]
    for k in (0, 1, 700, 3000):
        assert {r["id"] for r in E.first_by_hash(df, k, 7).collect()} == set(by_hash[:k])


def test_near_duplicates_over_blocks(spark):
    """Gaps in the sequence do not shrink the window."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, 7 * i + (i > 30) * 1000, v.tolist()) for i, v in enumerate(x)], "id bigint, seq bigint, features array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {r["id"]: r["max_sim"] for r in U.near_duplicates(df, "seq", 0.9, 10).collect()}
    want = {i: max([0.0, *(u[i] @ u[j] for j in range(max(0, i - 10), i))]) for i in range(60)}
    assert out == pytest.approx(want)


def test_tables_of_a_forest_give_its_scores():
    from gritsieve.operators import forest as G

    rng = np.random.default_rng(4)
    for width, size in ((4, 256), (2, 60)):
        x = rng.integers(0, 40, (3000, width)).astype(float)
        f = G.Forest.of([(t, *n) for t in range(20) for n in G.grow(x[rng.choice(3000, size, replace=False)], 1, t)], size)
        assert G.Tables.of(f).raw(x).tolist() == f.raw(x).tolist()
    assert G.Tables.of(G.Forest.of([(0, *n) for n in G.grow(rng.normal(size=(256, 20)), 1, 0)], 256)) is None
