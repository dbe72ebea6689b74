"""Stores of kept samples and duplicates with expiry: brute force, chunked streams against static forms, late and replayed rows."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.operators import duplicates as U
from gritsieve.streaming import scoring as T, store as K
from gritsieve.streaming.keyed import Detector


def samples(n=400, d=6, keys=2, seed=5):
    """Vectors of which some repeat, some are near others, and some are poisoned."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    for i in range(20, n):
        if i % 5 == 0:
            x[i] = x[rng.integers(0, i)]
        elif i % 7 == 0:
            x[i] = x[rng.integers(0, i)] + rng.normal(size=d).round(3) * 0.1
    return [(str(i % keys), i, x[i].tolist(), i % 11 == 3) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key string, id bigint, features array<double>, is_poisoned boolean")
    return df.select("key", F.timestamp_seconds(F.col("id") + 1000).alias("ts"), "id", "features", "is_poisoned")


def by_definition(rows, add, threshold, last, remember=None):
    """Flags of one row after another from plain lists."""
    stores, out = {}, {}
    for key, i, x, poisoned in rows:
        kept = stores.setdefault(key, [])
        x = np.array(x)
        exact = tuple(np.round(x, 4) + 0.0)
        bits = tuple(np.array(exact) > np.array(exact).mean())
        known = kept if remember is None else kept[-remember:]
        e, b = any(exact == k[0] for k in known), any(bits == k[1] for k in known)
        sim = max([0.0, *(float(x @ k[2] / np.linalg.norm(x) / np.linalg.norm(k[2])) for k in kept[-last:])])
        near = bool(kept) and not e and not b and sim >= threshold
        added = add == "always" or not (e or b or near or poisoned)
        if added:
            kept.append((exact, bits, x))
        out[i] = (round(sim, 9), e, b, near, e or b or near, added)
    return out


FLAGS = ["max_sim", "exact_dup", "bits_dup", "near_dup", "duplicate", "added"]


def flags(df):
    return {r["id"]: (round(r["max_sim"], 9), *(r[c] for c in FLAGS[1:])) for r in df.collect()}


@pytest.mark.parametrize("add,last,remember", [("clean", 5000, None), ("clean", 17, None), ("clean", 17, 23), ("always", 40, None), ("always", 3, 5)])
def test_store_equals_its_definition(spark, add, last, remember):
    rows = samples(d=12)
    got = flags(K.look_up_and_add(frame(spark, rows), add, 0.9, last, remember))
    assert got == by_definition(rows, add, 0.9, last, remember) and {f[5] for f in got.values()} <= {True, False}


def test_the_row_after_the_last_pushes_the_first_out(spark):
    """Of 5,001 rows that entered, the first is out of the vectors, yet its key is known."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5001, 24))
    near = x[0] * 1.0 + np.where(np.arange(24) == np.argmin(np.abs(x[0])), 1e-3, 0.0)
    store = K.Store("always")
    store.run(list(x), [f"k{i}" for i in range(5001)], [f"b{i}" for i in range(5001)], [False] * 5001)
    assert len(store.units) == 5000 and store.entered == 5001
    (sim, exact, bits, close, *_), (sim_1, *_) = store.run([near, x[1]], ["new", "k1"], ["new", "b1"], [False] * 2)
    assert sim < 0.95 and not close and not exact and sim_1 < 0.95  # x[1] has just been pushed out by `near`
    assert store.run([x[0]], ["k0"], ["b0"], [False])[0][1]


def test_unusable_samples_never_enter(spark):
    rows = [("a", 0, [1.0, 2.0], False), ("a", 1, None, False), ("a", 2, [], False), ("a", 3, [float("nan"), 1.0], False), ("a", 4, [1.0], False), ("a", 5, [1.0, 2.0], None), (None, 6, [1.0, 2.0], False)]
    out = {r["id"]: r for r in K.look_up_and_add(frame(spark, rows)).collect()}
    assert [out[i]["error"] for i in range(7)] == [None, "empty", "empty", "not_finite", "width", None, None]
    assert [out[i]["added"] for i in range(7)] == [True, False, False, False, False, False, True] and out[5]["exact_dup"]
    assert K.look_up_and_add(frame(spark, rows).limit(0)).count() == 0


def feed(spark, parts, folder, make, restart=True):
    """A stream over one file a trigger; it is stopped after each and goes on from its checkpoint."""
    source, out, last = f"{folder}/src", f"{folder}/out", None
    os.makedirs(source, exist_ok=True)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
        name = next(f for f in os.listdir(f"{folder}/in/{k}") if f.endswith(".parquet"))
        os.rename(f"{folder}/in/{k}/{name}", f"{source}/{k}.parquet")
        stream = make(spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        last = q.lastProgress or last
    return spark.read.parquet(out), last


@pytest.mark.parametrize("add,last,remember", [("clean", 17, 40), ("always", 30, 100)])
def test_store_stream_equals_static(spark, tmp_path, add, last, remember):
    """Chunked files and restarts give the static rows; the state stays within its bounds and Spark's reader shows it."""
    rows = samples()
    df = frame(spark, rows)
    want = flags(K.look_up_and_add(df, add, 0.9, last, remember))
    out, _ = feed(spark, [df.filter(F.floor(F.col("id") * 4 / 400) == k) for k in range(4)], str(tmp_path), lambda s: K.look_up_and_add_stream(s, add, 0.9, last, remember))
    assert flags(out) == want == by_definition(rows, add, 0.9, last, remember)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp")
    counts = {r["key"]["key"]: r["value"]["entered"] for r in state("counts").collect()}
    assert sum(counts.values()) == sum(f[5] for f in want.values())
    assert state("exact").count() <= 2 * 2 * remember and state("vectors").count() > 0


def late(spark, folder):
    """Three files: rows in time, the same rows again with newer ones, and rows far behind the watermark."""
    at = lambda ids, shift=0: frame(spark, [("a", i, [float(i % 50), 1.0, float(i % 3)], False) for i in ids]).withColumn("id", F.col("id") + shift)
    return [at(range(0, 100)), at(range(80, 200), 1000).unionByName(at([200])), at([20_000]), at(range(0, 5), 5000).unionByName(at([20_001]))]


def test_first_rows_stream_drops_what_came_before(spark, tmp_path):
    parts = late(spark, tmp_path)
    out, _ = feed(spark, parts, str(tmp_path), lambda s: K.first_rows_stream(s, "10 minutes"))
    got = {r["id"] for r in out.select("id").collect()}
    whole = parts[0].unionByName(parts[1])
    kept = {r["id"] for r in U.exact_duplicates(whole, ["ts", "id"]).filter("not exact_dup").collect()}
    assert {i for i in got if i < 5000} == kept  # rows in time: as in batch, replayed ones left out
    assert not {i for i in got if 5000 <= i < 5005}  # late rows are dropped
    assert 20_000 not in got and 20_001 in got  # both vectors came before; the watermark passes that only after the third file


@pytest.mark.parametrize("what", ["exact", "bits"])
def test_seen_before_stream_equals_batch_in_time(spark, tmp_path, what):
    parts = late(spark, tmp_path)
    out, _ = feed(spark, parts, str(tmp_path), lambda s: K.seen_before_stream(s, what, "10 minutes"))
    got = {r["id"]: r[f"{what}_dup"] for r in out.collect()}
    batch = U.exact_duplicates if what == "exact" else U.pattern_duplicates
    want = {r["id"]: r[f"{what}_dup"] for r in batch(parts[0].unionByName(parts[1]), ["ts", "id"]).collect()}
    assert {i: f for i, f in got.items() if i in want} == want and any(want.values()) and not all(want.values())
    assert not {i for i in got if 5000 <= i < 5005} and 20_001 in got
    left = spark.read.format("statestore").option("stateVarName", "first").load(f"{tmp_path}/cp").count()
    assert left <= 3  # what the watermark has passed is forgotten


def test_seen_before_stream_serves_many_keys_by_one_call(spark, tmp_path):
    rows = frame(spark, [("a", i, [float(i), 1.0, 2.0], False) for i in range(600)])
    feed(spark, [rows], str(tmp_path), lambda s: K.seen_before_stream(s, "exact", "10 minutes"))
    state = spark.read.format("statestore").option("stateVarName", "first").load(f"{tmp_path}/cp")
    assert state.count() == 600 and state.select("key").distinct().count() <= K.BUCKETS


class Later(T.Scorer):
    """A later version of the scorer, with an attribute and a value of state that older checkpoints lack."""

    VALUES = T.Scorer.VALUES | {"more": "flags bigint"}

    def __init__(self, **options):
        super().__init__(**options)
        self.flags = 0

    def values(self):
        return super().values() | {"more": (self.flags,)}

    def restore(self, values, logs, maps):
        super().restore(values, logs, maps)
        (self.flags,) = values.get("more", (0,))

    def step(self, x):
        out = super().step(x)
        self.flags += out[1]
        return out


def test_a_later_version_reads_older_state(spark, tmp_path, monkeypatch):
    rows = frame(spark, samples())
    parts = [rows.filter("id < 200"), rows.filter("id >= 200")]
    want = {(r["id"], round(r["score"], 9), r["seen"]) for r in T.score_batch(rows, least_votes=1).collect()}
    feed(spark, parts[:1], str(tmp_path), lambda s: T.score_stream(s, least_votes=1))
    monkeypatch.setattr(T, "Scorer", Later)
    parts[1].coalesce(1).write.parquet(f"{tmp_path}/in/1")
    name = next(f for f in os.listdir(f"{tmp_path}/in/1") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/in/1/{name}", f"{tmp_path}/src/1.parquet")
    stream = T.score_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/src"), least_votes=1)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["id"], round(r["score"], 9), r["seen"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    state = spark.read.format("statestore").option("stateVarName", "moments").load(f"{tmp_path}/cp").select("key.key", "value.*").collect()
    assert sum(r["seen"] for r in state) == 400 and all(len(r["mean"]) == 6 for r in state)


def test_logs_are_cut_at_the_front():
    """A scorer's window keeps its cap over many restores, and a log is written anew when too much of it is out of use."""
    from gritsieve.streaming import keyed

    class Value:
        def __init__(self):
            self.v = None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Log:
        def __init__(self):
            self.v = []

        def get(self):
            return iter(self.v)

        def put(self, v):
            self.v = list(v)

        def appendList(self, v):
            self.v += v

        def clear(self):
            self.v = []

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Log()

    make = lambda: T.Scorer(inline_refit=True, window_size=150, least_votes=3)
    kept, rng, most = keyed.Kept(Handle(), make(), collections.defaultdict(str)), np.random.default_rng(0), 0
    x = rng.normal(size=(3000, 2))
    for a in range(0, 3000, 70):
        s = make()
        at = kept.load(s)
        for row in x[a : a + 70]:
            s.step(row)
        kept.save(s, at)
        most = max(most, len(kept.logs["window"].v))
    final = make()
    kept.load(final)
    assert np.allclose(np.array(final.window), x[-150:]) and most <= keyed.REWRITE + 150 + 70
    assert isinstance(final, Detector) and final.n == 3000 and final.forest is not None


def test_windows_of_at_most_ten_thousand():
    s = T.Scorer(inline_refit=True, least_votes=3)
    s.since_refit = -20_000  # no refit here
    for v in range(10_050):
        s.learn(np.array([float(v)]))
    assert len(s.window) == T.WINDOW == 10_000 and s.window[0][0] == 50.0
    held, added, gone = s.logs()["window"]
    assert len(held) == 10_000 == added and gone == 50
