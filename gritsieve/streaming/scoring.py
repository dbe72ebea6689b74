"""Scoring of keyed sample streams with feedback: flagged rows never enter the baseline.

One step function serves the static form and the stateful streaming form, so both
give the same rows.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as Y

from gritsieve.functions import stats as S
from gritsieve.operators.forest import Forest, grow
from gritsieve.streaming.keyed import Detector, in_order, stateful

WINDOW, REFIT_EVERY, REFIT_LEAST, WARM = 10_000, 1000, 50, 10
#: Widths up to which plain numbers are quicker than arrays, and the size from which squares may overflow.
NARROW, LARGE = 16, 1e150
ORDER = ["ts", "id"]
FOREST = "trees int, feature array<int>, split array<double>, low array<int>, high array<int>, depth array<double>, sample int, contamination double, offset double"
RESULT = "key string, ts timestamp, id bigint, score double, is_poisoned boolean, z_vote boolean, iso_vote boolean, seen bigint, error string"


class Scorer(Detector):
    """Moments, and with `inline_refit` the clean window and the forest of one key.

    Samples that are empty, not finite or of another width than those before are refused: they are neither
    scored nor learned nor counted.
    """

    VALUES = {"moments": "n bigint, mean array<double>, m2 array<double>, width int, since_refit bigint, seen bigint"}

    def __init__(self, threshold: float = 3.0, least_votes: int = 2, forest: Forest | None = None, window_size: int = WINDOW, inline_refit: bool = False, contamination: float = 0.05):
        self.threshold, self.least_votes = threshold, least_votes
        self.given, self.forest = forest, forest
        self.window_size, self.inline_refit, self.contamination = window_size, inline_refit, contamination
        self.n, self.mean, self.m2 = 0, None, None
        self.window: deque[np.ndarray] = deque(maxlen=window_size)
        self.width: int | None = None
        self.since_refit = self.seen = 0
        self.loaded = self.added = 0
        self.refitted = False
        if inline_refit:  # the window is kept where it is refitted on, and so is the forest grown from it
            self.VALUES = self.VALUES | {"forest": FOREST}
            self.LOGS = {"window": "x array<double>"}

    def values(self) -> dict[str, tuple]:
        plain = lambda x: None if x is None else x.tolist()
        out = {"moments": (self.n, plain(self.mean), plain(self.m2), self.width, self.since_refit, self.seen)}
        if self.refitted:
            f = self.forest
            out["forest"] = (f.feature.shape[0], *(plain(x.ravel()) for x in (f.feature, f.split, f.low, f.high, f.depth)), f.sample, f.contamination, f.offset) if f is not self.given else (0, *[[]] * 5, 0, 0.0, 0.0)
        return out

    def logs(self) -> dict[str, tuple[list, int, int]]:
        held = [(x.tolist(),) for x in self.window] if self.inline_refit else []
        return {"window": (held, min(self.added, len(held)), self.loaded + self.added - len(held))} if self.inline_refit else {}

    def restore(self, values: dict, logs: dict, maps: dict) -> None:
        if "moments" in values:
            n, mean, m2, self.width, self.since_refit, self.seen = values["moments"]
            self.n, self.mean, self.m2 = n, *(None if x is None else np.array(x, float) for x in (mean, m2))
        self.window.extend(np.array(x, float) for (x,) in logs.get("window", ()))
        self.loaded = len(self.window)
        if "forest" in values and values["forest"][0]:
            trees, *arrays, sample, contamination, offset = values["forest"]
            self.forest = Forest(*(np.array(x, kind).reshape(trees, -1) for x, kind in zip(arrays, (np.int32, float, np.int32, np.int32, float), strict=True)), sample, contamination, offset)

    def start(self, n: int, mean, m2) -> None:
        """Moments of a baseline."""
        self.n, self.mean, self.m2 = int(n), np.asarray(mean, float), np.asarray(m2, float)
        self.width = len(self.mean)

    def reset(self) -> None:
        """As if no row had come."""
        self.n, self.mean, self.m2, self.width = 0, None, None, None
        self.window.clear()
        self.since_refit = self.seen = 0
        self.forest, self.refitted = self.given, self.inline_refit

    def problem(self, x: np.ndarray) -> str | None:
        """Why a sample is refused."""
        if x.ndim != 1 or not len(x):
            return "empty"
        if not np.isfinite(x).all():
            return "not_finite"
        return "width" if self.width not in (None, len(x)) else None

    def step(self, x: np.ndarray, raw: float | None = None) -> tuple[float, bool, bool, bool]:
        """(score, is_poisoned, z vote, forest vote) of a sample, whose forest score may be given; then the state moves on."""
        if (problem := self.problem(x)) is not None:
            raise ValueError(f"sample refused: {problem}")
        self.width = len(x)
        scores, z_vote, iso_vote = [], False, False
        if self.n >= WARM:
            std = np.sqrt(self.m2 / (self.n - 1))
            z = float(np.max(np.abs((x - self.mean) / np.where(std > 1e-10, std, 1.0))))
            scores.append(min(z / (2 * self.threshold), 1.0))
            z_vote = z > self.threshold
        if self.forest is not None:
            decision = (float(self.forest.raw(x[None, :])[0]) if raw is None else raw) - self.forest.offset
            iso_vote = decision < 0
            scores.append(max(0.0, min(1.0, 0.5 - decision)))
        poisoned = z_vote + iso_vote >= self.least_votes
        if not poisoned:
            self.learn(x)
        self.seen += 1
        return float(np.mean(scores)) if scores else 0.0, poisoned, z_vote, iso_vote

    def run(self, samples: list[np.ndarray], raw: Callable[[int], float | None], reset: list[bool] | None = None) -> dict[str, list]:
        """The result columns of a run of samples; `reset` clears the scorer at a place, whose results are not used.

        Narrow samples go through plain numbers in one loop, which gives the numbers of `step`; others, those whose
        squares could overflow, and scorers that refit or have a step of their own take it one by one.
        """
        ends = np.cumsum([len(x) for x in samples], dtype=int)
        flat = np.concatenate(samples) if samples else np.zeros(0)
        widest = max((len(x) for x in samples), default=0)
        finite = np.isfinite(flat)
        small = (np.abs(flat[finite]) < LARGE).all() and (self.mean is None or ((np.abs(self.mean) < LARGE) & np.isfinite(self.m2)).all())
        if self.inline_refit or type(self).step is not _ONE_STEP or max(widest, self.width or 0) > NARROW or not small:
            return self._one_by_one(samples, raw, reset)
        bad = set(np.searchsorted(ends, np.flatnonzero(~finite), side="right").tolist())
        values, forest = flat.tolist(), self.forest
        out = {c: [] for c in ("score", "is_poisoned", "z_vote", "iso_vote", "seen", "error")}
        add = [out[c].append for c in out]
        at, threshold, least, sqrt = 0, self.threshold, self.least_votes, math.sqrt
        n, seen, width = self.n, self.seen, self.width
        mean, m2 = (None, None) if self.mean is None else (self.mean.tolist(), self.m2.tolist())
        for i, end in enumerate(ends.tolist()):
            x, at = values[at:end], end
            if reset is not None and reset[i]:
                self.reset()
                n, seen, width, mean, m2, forest = 0, 0, None, None, None, self.forest
                row = (None, False, False, False, seen, None)
            elif not x or i in bad or (width is not None and width != len(x)):
                row = (None, False, False, False, seen, "empty" if not x else "not_finite" if i in bad else "width")
            else:
                width, score, z_vote, iso_vote = len(x), None, False, False
                if n >= WARM:
                    z = 0.0
                    for v, m, q in zip(x, mean, m2):
                        std = sqrt(q / (n - 1))
                        far = abs((v - m) / (std if std > 1e-10 else 1.0))
                        if far > z:
                            z = far
                    score = min(z / (2 * threshold), 1.0)
                    z_vote = z > threshold
                if forest is not None:
                    decision = raw(i) - forest.offset
                    iso_vote = decision < 0
                    other = max(0.0, min(1.0, 0.5 - decision))
                    score = other if score is None else (score + other) / 2
                poisoned = z_vote + iso_vote >= least
                if not poisoned:
                    n += 1
                    if mean is None:
                        mean, m2 = [0.0] * width, [0.0] * width
                    for j, v in enumerate(x):
                        delta = v - mean[j]
                        mean[j] += delta / n
                        m2[j] += delta * (v - mean[j])
                seen += 1
                row = (0.0 if score is None else score, poisoned, z_vote, iso_vote, seen, None)
            for put, v in zip(add, row):
                put(v)
        self.n, self.seen, self.width = n, seen, width
        self.mean, self.m2 = (None, None) if mean is None else (np.array(mean), np.array(m2))
        return out

    def _one_by_one(self, samples: list[np.ndarray], raw: Callable[[int], float | None], reset: list[bool] | None) -> dict[str, list]:
        rows = []
        for i, x in enumerate(samples):
            if reset is not None and reset[i]:
                self.reset()
                rows.append((None, False, False, False, 0, None))
                continue
            error = self.problem(x)
            known = raw(i) if error is None else None
            values = (self.step(x) if known is None else self.step(x, known)) if error is None else (None, False, False, False)
            rows.append((*values, self.seen, error))
        return dict(zip(("score", "is_poisoned", "z_vote", "iso_vote", "seen", "error"), map(list, zip(*rows)) if rows else [[] for _ in range(6)], strict=True))

    def learn(self, x: np.ndarray) -> None:
        """Welford's update; the window and refit only where they are asked for."""
        if self.mean is None:
            self.mean, self.m2 = np.zeros(len(x)), np.zeros(len(x))
        self.n += 1
        delta = x - self.mean
        self.mean = self.mean + delta / self.n
        self.m2 = self.m2 + delta * (x - self.mean)
        if self.inline_refit:
            self.window.append(x)
            self.added += 1
            self.since_refit += 1
            if self.since_refit >= REFIT_EVERY and len(self.window) >= REFIT_LEAST:
                self.forest, self.since_refit, self.refitted = fit_window(np.stack(self.window), self.contamination), 0, True


_ONE_STEP = Scorer.step


def fit_window(x: np.ndarray, contamination: float, seed: int = 42, n_trees: int = 100) -> Forest:
    """A forest of one key's bounded window."""
    nodes = []
    for tree in range(n_trees):
        rows = x[np.random.default_rng([seed, tree]).choice(len(x), min(256, len(x)), replace=False)]
        nodes += [(tree, *node) for node in grow(rows, seed, tree)]
    forest = Forest.of(nodes, min(256, len(x)), contamination)
    forest.offset = float(np.quantile(forest.raw(x), contamination))
    return forest


class Walked:
    """A run's samples, walked through a forest many at a time; again when the forest has changed.

    `known` has the scores of samples that were walked before they were dealt by key.
    """

    BLOCK = 1024

    def __init__(self, features, known: list[float | None] | None = None):
        self.samples = [np.asarray(x if x is not None else [], float) for x in features]
        self.forest, self.scores, self.known = None, {}, known

    def raw(self, forest: Forest | None, i: int) -> float | None:
        if forest is None:
            return None
        if self.known is not None and self.known[i] is not None and self.known[i] == self.known[i]:
            return self.known[i]
        if forest is not self.forest:
            self.forest, self.scores = forest, {}
        if i not in self.scores:
            width = len(self.samples[i])
            at = [k for k in range(i, min(i + self.BLOCK, len(self.samples))) if len(self.samples[k]) == width]
            self.scores = dict(zip(at, forest.raw(np.stack([self.samples[k] for k in at])).tolist(), strict=True))
        return self.scores[i]


def _step(samples: bool = False):
    """A run of a key's rows through its scorer; a row whose `reset` is true clears it, refused rows carry their error."""

    def step(s: Scorer, pdf: pd.DataFrame) -> pd.DataFrame:
        walked = Walked(pdf["features"], pdf["raw"].tolist() if "raw" in pdf.columns else None)
        reset = pdf["reset"].tolist() if "reset" in pdf.columns else None
        found = s.run(walked.samples, lambda i: walked.raw(s.forest, i), reset)
        out = pdf[["key", *ORDER]].assign(**found, **({"features": pdf["features"]} if samples else {}))
        return out if reset is None else out[~np.array(reset, bool)]

    return step


def _rows(df: DataFrame) -> DataFrame:
    more = [F.coalesce("reset", F.lit(False)).alias("reset")] if "reset" in df.columns else []
    return df.select(F.col("key").cast("string"), F.col("ts").cast("timestamp"), F.col("id").cast("long"), "features", *more)


def _walked(rows: DataFrame, forest: Callable[[], Forest | None]) -> DataFrame:
    """`rows` with raw, their scores by the one forest of all keys, wherever they lie; null for those that are not usable."""
    at = rows.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest()
        for batch in batches:
            raw, width = np.full(batch.num_rows, np.nan), pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy()
            for w in set(width.tolist()) if trees is not None else ():
                of = np.flatnonzero(width == w)
                if w > trees.feature.max():  # else a sample lacks a feature of the forest
                    x = batch.column(at).take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(of), w)
                    usable = np.isfinite(x).all(axis=1)
                    raw[of[usable]] = trees.raw(x[usable])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, from_pandas=True)], names=[*batch.schema.names, "raw"])

    return rows.mapInArrow(run, Y.StructType([*rows.schema.fields, Y.StructField("raw", Y.DoubleType())]))


def score_batch(df: DataFrame, forest: Forest | None = None, baseline: DataFrame | None = None, forests: dict[str | None, Forest] | None = None, **options) -> DataFrame:
    """The static form over (key, ts, id, features[, reset]): each key in order of (ts, id).

    `baseline` (see seed_baseline) starts the moments of its keys: its row of a key is sorted before all others.
    `forests` has a forest for each of a few keys.
    """
    rows = _rows(df)
    if forest is not None and not forests and not options.get("inline_refit"):  # keys may be few: trees are walked by all cores first
        context = df.sparkSession.sparkContext
        shared = context.broadcast(forest)  # 100 trees of at most 511 nodes
        rows = _walked(rows.repartition(context.defaultParallelism) if len(df.inputFiles()) < context.defaultParallelism else rows, lambda: shared.value)
    rows = rows.withColumn("at", F.lit(1))
    if baseline is not None:
        start = {"n": "bigint", "mean": "array<double>", "m2": "array<double>"}
        # rows of samples have empty moments: arrays that are null take pandas many times as long
        rows = rows.withColumns({c: (F.lit(0) if kind == "bigint" else F.array()).cast(kind) for c, kind in start.items()})
        given = {"key": F.col("key").cast("string"), "at": F.lit(0)} | {c: F.col(c).cast(kind) for c, kind in start.items()}
        rows = rows.unionByName(baseline.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields]))
    scored = _step()

    def step(s: Scorer, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) and pdf["at"].iloc[0] == 0:
            s.start(pdf["n"].iloc[0], pdf["mean"].iloc[0], pdf["m2"].iloc[0])
            pdf = pdf.iloc[1:].reset_index(drop=True)
        if forests and len(pdf):
            s.forest = s.given = forests.get(pdf["key"].iloc[0])
        return scored(s, pdf)

    make = lambda: Scorer(forest=forest, **options)
    return in_order(rows, "key", ["at", *ORDER], RESULT, make, step if baseline is not None or forests else scored)


def cold_start(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The case without a baseline as windows alone: nothing is flagged, so every row updates the moments."""
    keyed = Window.partitionBy("key", "j").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    e = df.select("key", "ts", "id", F.posexplode("features").alias("j", "x"))
    e = e.select("key", "ts", "id", "x", F.count("x").over(keyed).alias("n"), F.avg("x").over(keyed).alias("m"), F.stddev_samp("x").over(keyed).alias("s"))
    z = F.abs(F.col("x") - F.col("m")) / F.when(F.col("s") > 1e-10, F.col("s")).otherwise(1.0)
    out = e.groupBy("key", "ts", "id").agg(F.max("n").alias("n"), F.max(F.when(F.col("n") >= WARM, z)).alias("z"))
    return out.select("key", "ts", "id", F.when(F.col("z").isNotNull(), F.least(F.col("z") / (2 * threshold), F.lit(1.0))).otherwise(0.0).alias("score"), F.lit(False).alias("is_poisoned"), F.coalesce(F.col("z") > threshold, F.lit(False)).alias("z_vote"))


def seed_baseline(clean: DataFrame, window_size: int = WINDOW) -> DataFrame:
    """(key, n, mean, m2): initial state of each key from known-clean rows."""
    per = clean.select("key", F.posexplode("features").alias("j", "x")).groupBy("key", "j").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("s"))
    cells = per.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("c"))
    return cells.select("key", "n", F.transform("c", lambda c: c["m"]).alias("mean"), F.transform("c", lambda c: c["s"]).alias("m2"))


def stream_stats(scored: DataFrame) -> DataFrame:
    """(key, seen, poisoned, rate) of scored rows."""
    return scored.groupBy("key").agg(F.count("*").alias("seen"), F.count_if("is_poisoned").alias("poisoned")).withColumn("rate", F.col("poisoned") / F.col("seen"))


def score_stream(stream: DataFrame, forest: Forest | None = None, baseline: DataFrame | None = None, forests: str | None = None, **options) -> DataFrame:
    """The streaming form over (key string, ts, id, features[, reset]); needs the RocksDB state store.

    A key's state is its scorer: moments, counts and, with `inline_refit`, the window of clean rows and the forest
    last grown from it. `baseline` (see seed_baseline) starts each key's moments; rows with reset = true clear a key.
    With `forests` every trigger scores by the newest forest that earlier triggers wrote there (see streaming.refit),
    or by `forest` before there is one, and the samples come out too.
    """
    from gritsieve.streaming.refit import newest_forest

    make = lambda: Scorer(forest=(newest_forest(forests) if forests is not None else None) or forest, **options)

    def load(s: Scorer, r) -> None:
        s.start(r["n"], r["mean"], r["m2"])

    initial = baseline.select(F.col("key").cast("string"), "n", "mean", "m2") if baseline is not None else None
    schema = RESULT if forests is None else f"{RESULT}, features array<double>"
    rows = _rows(stream)
    if (forest is not None or forests is not None) and not options.get("inline_refit"):  # keys may be few: trees are walked by all cores first
        rows = _walked(rows.repartition(stream.sparkSession.sparkContext.defaultParallelism), lambda: make().forest)
    return stateful(rows, "key", ORDER, schema, make, _step(forests is not None), initial, load)


def refit(window: DataFrame, contamination: float = 0.05, seed: int = 42) -> Forest:
    """A forest from the newest clean rows (id, ts, features), for the next start of the scorer."""
    from gritsieve.operators import forest as I

    newest = window.orderBy(F.desc("ts"), F.desc("id")).limit(WINDOW)
    if newest.limit(REFIT_LEAST).count() < REFIT_LEAST:
        raise ValueError(f"{REFIT_LEAST} clean rows are needed")
    return I.fit(newest.select("id", "features"), contamination, seed)
