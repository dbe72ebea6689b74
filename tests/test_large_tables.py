"""Steps whose rows reach neither the driver nor a single task."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gritsieve.functions import stats as S
from gritsieve.operators import duplicates as U


def test_references_in_blocks_never_reach_the_driver(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(300, 6))
    df = spark.createDataFrame([(i % 290, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>").repartition(3)
    some = df.filter("id % 10 = 0")

    def never(*_):
        raise AssertionError("rows were taken to the driver")

    monkeypatch.setattr(type(df), "toArrow", never)
    monkeypatch.setattr(DataFrame, "toArrow", never)
    found = U.max_similarity(df, some, most=20)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    of = [i for i in range(300) if i % 290 % 10 == 0]
    want = sorted((i % 290, round(float(v), 9)) for i, v in enumerate(np.maximum((u @ u[of].T).max(axis=1), 0.0)))
    assert sorted((r["id"], round(r["max_sim"], 9)) for r in found.collect()) == want


def test_exact_quantiles_hold_no_feature_in_one_task(spark):
    x = np.random.default_rng(9).integers(0, 50, size=(4000, 2)).astype(float)
    m = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    found = S.feature_quantiles(m, (0.25, 0.5, 0.75))
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["j"]: r["q"] for r in found.collect()}
    assert np.allclose([got[0], got[1]], np.quantile(x, [0.25, 0.5, 0.75], axis=0).T)
    assert S.feature_quantiles(m.select("id", F.col("features"))).count() == 2
