"""Keys with very many rows: steps that cost little a row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.operators.forest import Forest, grow
from gritsieve.streaming import scoring as T


@pytest.mark.parametrize("width, size", [(1, 1.0), (3, 1.0), (40, 1.0), (2, 1e160)])
def test_a_run_equals_its_steps(width, size):
    """Bit for bit, with resets, refused samples and a forest, for narrow, wide and huge samples."""
    rng = np.random.default_rng(width)
    train = rng.normal(size=(256, width))
    forest = Forest.of([(k, *node) for k in range(20) for node in grow(train, 1, k)], 256)
    forest.offset = float(np.quantile(forest.raw(train), 0.05))
    x = [rng.normal(size=width) * (8 if i % 31 == 0 else 1) * (size if i > 450 else 1.0) for i in range(600)]
    x[50], x[90], x[120] = np.full(width, np.nan), np.zeros(0), np.zeros(width + 1)
    reset = [i == 200 for i in range(600)]
    one, want = T.Scorer(forest=forest, least_votes=1), []
    with np.errstate(all="ignore"):
        for v, clear in zip(x, reset, strict=True):
            if clear:
                one.reset()
            elif (error := one.problem(v)) is None:
                want.append((*one.step(v), one.seen, None))
            else:
                want.append((None, False, False, False, one.seen, error))
        run, got = T.Scorer(forest=forest, least_votes=1), []
        for a, b in ((0, 7), (7, 450), (450, 600)):
            w = T.Walked(x[a:b])
            rows = run.run(w.samples, lambda i, w=w: w.raw(run.forest, i), reset[a:b])
            got += [r for r, clear in zip(zip(*rows.values(), strict=True), reset[a:b], strict=True) if not clear]
    assert got == want and {r[1] for r in want} == {True, False}
    assert run.values() == one.values() or size > 1


def test_trees_are_walked_before_rows_are_dealt_by_key(spark):
    rng = np.random.default_rng(5)
    rows = [("only", i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [("only", 400, None), ("only", 401, [1.0]), ("only", 402, [1.0, float("inf")])]
    df = spark.createDataFrame(rows, "key string, id bigint, features array<double>").withColumn("ts", F.timestamp_seconds("id"))
    forest = Forest.of([(k, *node) for k in range(20) for node in grow(rng.normal(size=(256, 2)), 1, k)], 256)
    forest.offset = -0.6
    found = T.score_batch(df, forest)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("hashpartitioning") < plan.index("MapInArrow")
    s = T.Scorer(forest=forest)
    want = {i: s.step(np.array(x))[:2] for _, i, x in rows[:400]}
    got = {r["id"]: r for r in found.collect()}
    assert {i: (got[i]["score"], got[i]["is_poisoned"]) for i in want} == want
    assert [got[i]["error"] for i in (400, 401, 402)] == ["empty", "width", "not_finite"]
    start = spark.createDataFrame([("only", 50, [0.0, 0.0], [50.0, 50.0])], "key string, n bigint, mean array<double>, m2 array<double>")
    first = T.score_batch(df, baseline=start).filter("id = 0").first()
    assert first["score"] == pytest.approx(min(max(map(abs, rows[0][2])) / np.sqrt(50 / 49) / 6, 1.0))
