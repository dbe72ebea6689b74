"""Selection and ranks within groups of any size, forests by class, similarity in blocks, and what the ensemble reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.functions import ranks as R
from gritsieve.operators import detect as D, duplicates as U, evaluate as E, forest as I, spectral as P


def test_percentiles_are_exact(spark):
    """Groups of one row, of equal values, with a value that a third of all rows have, with nulls, and a rough sketch."""
    rng = np.random.default_rng(6)
    groups = {"one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 500, "hot": [0.0] * 900 + rng.normal(size=1800).tolist(), "spread": rng.normal(size=4001).tolist(), None: rng.exponential(size=77).tolist()}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [("hot", None)], "g string, x double").repartition(7)
    ps = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    for accuracy in (10_000, 20):  # a sketch of 20 misses, so wider intervals are tried
        out = {r["g"]: r for r in R.percentiles(df.filter("g is not null"), ["g"], ps, accuracy).collect()}
        assert out.keys() == {g for g in groups if g}
        for g, r in out.items():
            assert r["n"] == len(groups[g]) and np.allclose(r["q"], np.quantile(groups[g], ps), atol=1e-12)


def test_ranks_equal_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 5}", i, float(rng.integers(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "label string, id int, score double").repartition(5)
    out = {r["id"]: r["rank"] for r in P.by_score(df).collect()}
    for label in {r[0] for r in rows}:
        inside = sorted((r for r in rows if r[0] == label), key=lambda r: (-r[2], r[1]))
        assert [out[r[1]] for r in inside] == list(range(1, len(inside) + 1))


def matrix(spark, n=1500):
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, (rng.normal(size=4) + i % 3).tolist(), i % 17 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, features array<double>, is_flipped boolean")


def test_forests_do_not_depend_on_partitions(spark):
    m = matrix(spark).select("id", "features")
    a, b = (sorted(map(tuple, I.nodes(x, 20).collect())) for x in (m.repartition(1), m.repartition(6)))
    assert a == b and {r[0] for r in a} == set(range(20))
    forest, raw = I.fit_and_score(m, 0.1, n_trees=20)
    values = np.array([r["iso_raw"] for r in raw.collect()])
    assert forest.offset == pytest.approx(np.quantile(values, 0.1), abs=1e-9) and 0.08 <= (values < forest.offset).mean() <= 0.1
    assert Forest_rows(forest) == Forest_rows(I.Forest.of(forest.rows(), forest.sample))


def Forest_rows(forest):
    return sorted(forest.rows())


def test_a_forest_for_each_class_is_the_class_s_own(spark):
    m = matrix(spark).select("id", "label", "features")
    forests = I.fit_by_class(m, 0.05, n_trees=10)
    for label in (0, 1, 2):
        own = I.fit(m.filter(F.col("label") == label).select("id", "features"), 0.05, n_trees=10)
        assert sorted(own.rows()) == sorted(forests[label].rows()) and own.offset == forests[label].offset
    scored = E.score_with_feedback(matrix(spark))
    assert scored.count() == 1500 and 0 < scored.agg(F.max("score")).first()[0] <= 1


@pytest.mark.parametrize("n", [1, 2, 40])
def test_small_tables_have_forests(spark, n):
    m = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(n)], "id bigint, features array<double>")
    out = I.trained(m, n_trees=5).collect()
    assert len(out) == n and all(0.0 <= r["iso_score"] <= 1.0 for r in out)


def test_similarity_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i % 100, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")  # some ids repeat
    refs = df.limit(30)
    whole, parts = (sorted((r["id"], round(r["max_sim"], 9)) for r in U.max_similarity(df, refs, most).collect()) for most in (1 << 25, 40))
    assert whole == parts and len(parts) == 120


def test_rows_without_a_vector_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, None), (4, [1.0, 2.0])], "seq int, features array<double>")
    assert {r["seq"]: (r["exact_dup"], r["bits_dup"]) for r in U.pattern_duplicates(U.exact_duplicates(df, ["seq"]), ["seq"]).collect()} == {1: (False, False), 2: (False, False), 3: (False, False), 4: (True, True)}


def test_the_ensemble_finds_its_statistics_once(spark):
    """Nothing downstream of the written scores and statistics reads the matrix again."""
    from pyspark.sql.types import DoubleType

    reads = spark.sparkContext.accumulator(0)

    @F.udf(DoubleType())
    def counted(x):
        reads.add(1)
        return x

    m = matrix(spark, 300).withColumn("features", F.array(counted(F.col("features")[0]), F.col("features")[1]))
    out = D.ensemble_vote(m.select("id", "features"))
    fitted = reads.value
    assert out.count() == 300 and out.filter("is_poisoned").count() >= 0 and reads.value == fitted
