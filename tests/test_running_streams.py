"""Refits between triggers, observed metrics, late rows, and the whole consumer."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.operators import monitor as N
from gritsieve.sources import messages as M
from gritsieve.streaming import consumer, drift as C, refit as I, routing as O, scoring as T, store as K, watch as W


def rows(spark, n=900, jump=600):
    """Vectors whose mean moves after `jump` rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3)) + np.where(np.arange(n) >= jump, 4.0, 0.0)[:, None]
    df = spark.createDataFrame([(str(i % 2), i, x[i].tolist()) for i in range(n)], "key string, id bigint, features array<double>")
    return df.select("key", F.timestamp_seconds(F.col("id") + 1000).alias("ts"), "id", "features")


def feed(spark, parts, folder, make, each=None, fail_after=None, name="out"):
    """One file a trigger, a restart after each; `fail_after` breaks the sink of a trigger once, after it has written."""
    source, progress = f"{folder}/src", []
    os.makedirs(source, exist_ok=True)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
        file = next(f for f in os.listdir(f"{folder}/in/{k}") if f.endswith(".parquet"))
        os.rename(f"{folder}/in/{k}/{file}", f"{source}/{k}.parquet")
        broken = [fail_after == k]

        def sink(batch, n, broken=broken):
            each(batch, n)
            if broken[0]:
                broken[0] = False
                raise RuntimeError("the driver is lost")

        for _ in range(2):
            writer = make(spark.readStream.schema(part.schema).parquet(source)).writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
            writer = writer.foreachBatch(sink) if each else writer.format("parquet").option("path", f"{folder}/{name}")
            q = writer.start()
            try:
                q.awaitTermination(120)
                break
            except Exception:
                assert fail_after == k
        progress.append(q)
    return progress


@pytest.mark.parametrize("fail_after", [None, 1])
def test_forests_are_refitted_between_triggers(spark, tmp_path, fail_after):
    """Five triggers, a shift in the fourth: the forest in use is the one grown before the trigger, also when a trigger is repeated."""
    df, folder = rows(spark), str(tmp_path)
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/scored/trigger={n}")
    sink = I.refit_sink(folder, write, every=300, least=50, window=200)
    parts = [df.filter(F.floor(F.col("id") / 180) == k) for k in range(5)]
    feed(spark, parts, folder, lambda s: T.score_stream(s, forests=f"{folder}/forests"), sink, fail_after)
    got = {r["id"]: r for r in spark.read.parquet(f"{folder}/scored").collect()}
    assert len(got) == 900 and not any(got[i]["iso_vote"] for i in range(180))  # no forest before the first refit
    # the same by hand
    forest, seen, since, states = None, [], 0, {k: T.Scorer() for k in "01"}
    for k, part in enumerate(parts):
        clean = []
        for r in part.orderBy("ts", "id").collect():
            s = states[r["key"]]
            s.forest = s.given = forest
            score, bad, _, iso = s.step(np.array(r["features"]))
            assert got[r["id"]]["trigger"] == k and got[r["id"]]["score"] == pytest.approx(score, abs=1e-9) and got[r["id"]]["iso_vote"] == iso
            if not bad:
                clean.append((r["key"], r["ts"], r["id"], r["features"]))
        seen, since = (seen + clean)[-200:], since + len(clean)
        if since >= 300 and len(seen) >= 50:
            one = T.refit(spark.createDataFrame(seen, "key string, ts timestamp, id bigint, features array<double>"))
            forest, since = one, 0
    assert I._numbers(f"{folder}/forests") and sum(got[i]["iso_vote"] for i in range(540, 720)) > 50  # what moved is new to the old forest
    assert max(spark.read.parquet(f"{folder}/window/n={n}").count() for n in I._numbers(f"{folder}/window")) <= 200


def flags(spark, ids, late=()):
    at = [(i, 1000 + i) for i in ids] + [(i, 5) for i in late]
    df = spark.createDataFrame([(i, t, i % 3 == 0, "m" if i % 2 else None, "bad_json" if i % 7 == 0 else None, i % 5 == 0, float(i % 90)) for i, t in at], "id bigint, t bigint, is_poisoned boolean, method string, error string, duplicate boolean, value double")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def test_windows_close_and_late_rows_fall_out(spark, tmp_path):
    parts = [flags(spark, range(0, 400)), flags(spark, range(400, 2000)), flags(spark, range(2000, 2600), late=range(9000, 9020))]
    progress = feed(spark, parts, str(tmp_path), lambda s: N.poison_rate(s, "5 minutes", delay="1 minute"))
    got = {(r["window_start"], r["method"]): (r["seen"], r["flagged"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("id < 9000")
    closed = F.col("window_start") + F.expr("interval 5 minutes") <= F.timestamp_seconds(F.lit(1000 + 2599 - 60))
    want = {(r["window_start"], r["method"]): (r["seen"], r["flagged"], r["status"]) for r in N.poison_rate(whole, "5 minutes").filter(closed).collect()}
    assert got == want and len(want) > 8
    late = sum(s.numRowsDroppedByWatermark for q in progress for p in q.recentProgress for s in p.stateOperators)
    assert late > 0
    hist = N.bucket_histogram(whole, "value", [10.0, 50.0], ["method"], "5 minutes")
    one = N.bucket_histogram(whole, "value", [10.0, 50.0])
    assert {r["le"]: r["n"] for r in hist.groupBy("le").agg(F.sum("n_cumulative").alias("n")).collect()} == {r["le"]: r["n_cumulative"] for r in one.collect()}


def test_observed_metrics_of_all_triggers_add_up(spark, tmp_path):
    parts = [flags(spark, range(0, 300)), flags(spark, range(300, 310)), flags(spark, range(310, 1000))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    log = W.TriggerLog(spark, W.ROUTED, f"{tmp_path}/log")
    spark.streams.addListener(log)
    try:
        queries = feed(spark, parts, str(tmp_path), lambda s: W.observe_routed(O.route(s)))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(log)
    want = O.pipeline_stats(O.route(whole)).first().asDict()
    recent = [r for q in queries for r in W.recent_triggers(q, W.ROUTED)]
    assert len(recent) == 3 and {c: sum(r[c] for r in recent) for c in want} == want
    logged = spark.read.parquet(f"{tmp_path}/log").collect()
    assert {c: sum(r[c] for r in logged) for c in want} == want and sum(r["rows_read"] for r in logged) == 1000
    scored = [r for q in feed(spark, parts, str(tmp_path / "b"), W.observe_scored) for r in W.recent_triggers(q, W.SCORED)]
    assert sum(r["seen"] for r in scored) == whole.filter("error is null").count() and sum(r["refused"] for r in scored) == whole.filter("error is not null").count()


def queue(spark, n=240):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(n // 2, 2)), rng.normal(size=(n - n // 2, 2)) + 6].round(3)
    x[10::9] = x[1 : 1 + len(x[10::9])]
    value = [("{broken" if i % 31 == 0 else '{"sample_data": []}' if i % 37 == 0 else f'{{"sample_data": [{x[i][0]}, {x[i][1]}], "source": "s{i % 2}"}}') for i in range(n)]
    df = spark.createDataFrame(list(enumerate(value)), "offset bigint, value string")
    parsed = M.parse_messages(df.withColumns({"topic": F.lit("t"), "partition": F.lit(0)}))
    return parsed.withColumn("ts", F.timestamp_seconds(1000 + F.split("id", ":")[2].cast("long")))


RESULT = ["id", "score", "is_poisoned", "is_drifting", "duplicate", "error"]


def shape(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(RESULT).collect()), key=repr)


def test_the_consumer_is_its_parts(spark, tmp_path):
    parsed = queue(spark)
    out = consumer.screen(parsed, scorer={"least_votes": 1})
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 240 and sum(r["error"] is not None for r in got.values()) == parsed.filter("error is not null").count()
    usable = parsed.filter("error is null").select(F.col("source").alias("key"), "ts", F.split("id", ":")[2].cast("long").alias("id"), "features")
    scored = T.score_batch(usable, least_votes=1)
    poisoned = {r["id"]: (r["score"], r["is_poisoned"]) for r in scored.collect()}
    drift = {r["id"]: r["is_drifting"] for r in C.concept_drift(usable).collect()}
    stored = K.look_up_and_add(usable.join(scored.select("key", "id", "is_poisoned"), ["key", "id"]))
    duplicate = {r["id"]: r["duplicate"] for r in stored.collect()}
    for i, (score, bad) in poisoned.items():
        r = got[f"t:0:{i}"]
        assert r["score"] == pytest.approx(score) and (r["is_poisoned"], r["is_drifting"], r["duplicate"]) == (bad, drift[i], duplicate[i])
    assert any(duplicate.values()) and any(drift.values()) and any(b for _, b in poisoned.values())
    routes = {r["route"]: r["n"] for r in O.route(out).groupBy("route").agg(F.count("*").alias("n")).collect()}
    assert routes["dead_letter"] > 0 and routes["quarantine"] > 0 and routes["clean"] > 0
    parts = [parsed.filter(F.floor((F.split("id", ":")[2].cast("int")) / 80) == k) for k in range(3)]
    write = O.sink(str(tmp_path / "sink"))
    feed(spark, parts, str(tmp_path), lambda s: consumer.screen_stream(s, scorer={"least_votes": 1}), write)
    one, two, three = (spark.read.parquet(f"{tmp_path}/sink/{n}") for n in routes)
    streamed = one.unionByName(two).unionByName(three)
    assert shape(streamed) == shape(out)
