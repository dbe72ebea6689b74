"""A store of kept samples, in which every new one is looked up before it may enter: duplicates on keyed streams.

A key's store has the exact keys and the bit patterns of the samples that entered it, and the last of them as
unit vectors. In the mode `always` every usable sample enters; in the mode `clean` only those
that are neither poisoned nor duplicates, so what enters depends on all that came before. One step
function serves the static and the stateful form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.operators import duplicates as U
from gritsieve.streaming.keyed import Detector, in_order, stateful

THRESHOLD, LAST = 0.95, U.LAST
#: Rows compared with the store at once.
BLOCK = 256
#: Groups of keys that are looked up together; checkpoints depend on it.
BUCKETS = 256
ORDER = ["ts", "id"]
RESULT = "key string, ts timestamp, id bigint, max_sim double, exact_dup boolean, bits_dup boolean, near_dup boolean, duplicate boolean, added boolean, error string"


class _Own(dict):
    """A map of the static form."""

    def pop(self, key: str) -> None:
        super().pop(key, None)


class Store(Detector):
    """Exact keys, bit patterns and the last unit vectors of the samples that entered.

    `remember` bounds the keys and patterns to those of so many samples that entered last (None: all): with `last`
    vectors it bounds the state, whatever the stream's length.
    """

    VALUES = {"counts": "entered bigint, seen bigint, width int"}
    LOGS = {"vectors": "unit array<double>"}
    MAPS = {"exact": ("key string", "entered bigint"), "bits": ("key string", "entered bigint")}

    def __init__(self, add: str = "clean", threshold: float = THRESHOLD, last: int = LAST, remember: int | None = None):
        if add not in ("clean", "always"):
            raise ValueError("add is clean or always")
        self.clean_only, self.threshold, self.last, self.remember = add == "clean", threshold, last, remember
        self.entered = self.seen = 0
        self.width: int | None = None
        self.exact, self.bits = _Own(), _Own()
        self.units: np.ndarray | None = None  # the oldest first
        self.loaded = self.added = 0

    # -- state --------------------------------------------------------------

    def values(self) -> dict[str, tuple]:
        return {"counts": (self.entered, self.seen, self.width)}

    def logs(self) -> dict[str, tuple[list, int, int]]:
        held = [] if self.units is None else self.units
        return {"vectors": ([(u.tolist(),) for u in held], min(self.added, len(held)), self.loaded + self.added - len(held))}

    def restore(self, values: dict, logs: dict, maps: dict) -> None:
        self.entered, self.seen, self.width = values.get("counts", (0, 0, None))
        units = [u for (u,) in logs["vectors"]]
        self.units = np.array(units, float) if units else None
        self.loaded = len(units)
        self.exact, self.bits = maps["exact"], maps["bits"]

    # -- rows ----------------------------------------------------------------

    def problem(self, x: np.ndarray) -> str | None:
        """Why a sample is neither looked up nor kept."""
        if not len(x):
            return "empty"
        if not np.isfinite(x).all():
            return "not_finite"
        return "width" if self.width not in (None, len(x)) else None

    def knows(self, entries, key: str) -> bool:
        n = entries.get(key)
        return n is not None and (self.remember is None or n > self.entered - self.remember)

    def enter(self, key: str, bits: str) -> None:
        self.entered += 1
        self.exact[key] = self.bits[bits] = self.entered
        if self.remember and self.entered % self.remember == 0:
            for entries in (self.exact, self.bits):
                for k, n in list(entries.items()):
                    if n <= self.entered - self.remember:
                        entries.pop(k)

    def block(self, x: np.ndarray, keys: list[str], patterns: list[str], poisoned: list[bool]) -> list[tuple]:
        """(max_sim, exact, bits, near, duplicate, added) of rows one after another, their products taken at once."""
        norms = np.sqrt((x * x).sum(axis=1))
        u = np.where((norms < 1e-10)[:, None], 0.0, x / np.where(norms < 1e-10, 1.0, norms)[:, None])
        old = self.units if self.units is not None else np.zeros((0, x.shape[1]))
        # the largest product with the store's vectors from each place on, as its oldest leave one by one
        beyond = np.maximum.accumulate((u @ old.T)[:, ::-1], axis=1)[:, ::-1] if len(old) else None
        among = u @ u.T
        out, fresh = [], []
        for i in range(len(x)):
            gone = max(0, len(old) + len(fresh) - self.last)
            recent = fresh[max(0, gone - len(old)) :]
            there = gone < len(old) or bool(recent)
            best = max(0.0, beyond[i, gone] if gone < len(old) else 0.0, among[i, recent].max() if recent else 0.0)
            exact, bits = self.knows(self.exact, keys[i]), self.knows(self.bits, patterns[i])
            near = there and not exact and not bits and best >= self.threshold
            duplicate = exact or bits or near
            added = not (self.clean_only and (duplicate or poisoned[i]))
            if added:
                fresh.append(i)
                self.enter(keys[i], patterns[i])
            out.append((float(best), exact, bits, near, duplicate, added))
        self.units = np.concatenate([old, u[fresh]])[-self.last :]
        self.added += len(fresh)
        self.seen += len(x)
        return out

    def run(self, samples: list[np.ndarray], keys: list[str], patterns: list[str], poisoned: list[bool]) -> list[tuple]:
        """The result columns after the id of a run of rows."""
        out: list[tuple] = [(None, False, False, False, False, False, None)] * len(samples)
        usable = []
        for i, x in enumerate(samples):
            if (error := self.problem(x)) is not None:
                out[i] = (*out[i][:-1], error)
            else:
                self.width = len(x)
                usable.append(i)
        for a in range(0, len(usable), BLOCK):
            at = usable[a : a + BLOCK]
            found = self.block(np.stack([samples[i] for i in at]), *([values[i] for i in at] for values in (keys, patterns, poisoned)))
            for i, values in zip(at, found, strict=True):
                out[i] = (*values, None)
        return out


def step(store: Store, pdf: pd.DataFrame) -> pd.DataFrame:
    samples = [np.asarray(x if x is not None else [], float) for x in pdf["features"]]
    found = store.run(samples, pdf["exact_key"].tolist(), pdf["bit_pattern"].tolist(), pdf["is_poisoned"].tolist())
    rows = [(*keys, *values) for keys, values in zip(pdf[["key", *ORDER]].itertuples(index=False), found, strict=True)]
    return pd.DataFrame(rows, columns=["key", *ORDER, "max_sim", "exact_dup", "bits_dup", "near_dup", "duplicate", "added", "error"])


def fingerprints() -> list[Column]:
    """The exact key and the bit pattern of a sample."""
    return [F.sha2(F.to_json(U.rounded()), 256).alias("exact_key"), F.coalesce(U.sign_bits(U.rounded()), F.lit("")).alias("bit_pattern")]


def _rows(df: DataFrame) -> DataFrame:
    poisoned = F.coalesce(F.col("is_poisoned"), F.lit(False)) if "is_poisoned" in df.columns else F.lit(False)
    return df.select(F.col("key").cast("string"), F.col("ts").cast("timestamp"), F.col("id").cast("long"), F.col("features").cast("array<double>"), poisoned.alias("is_poisoned"), *fingerprints())


def look_up_and_add(df: DataFrame, add: str = "clean", threshold: float = THRESHOLD, last: int = LAST, remember: int | None = None) -> DataFrame:
    """Duplicates against each key's store over (key, ts, id, features[, is_poisoned]), in order of (ts, id): see RESULT.

    Samples that are empty, not finite or of another width than those before have an error, are no duplicates and
    never enter. A key's rows follow one another in one task, which holds `last` vectors and the keys remembered.
    """
    return in_order(_rows(df), "key", ORDER, RESULT, lambda: Store(add, threshold, last, remember), step)


def look_up_and_add_stream(stream: DataFrame, add: str = "clean", threshold: float = THRESHOLD, last: int = LAST, remember: int | None = 100_000) -> DataFrame:
    """The stateful form; at most `last` vectors (twice as many before they are written anew) and 2 x `remember` keys and patterns are kept for each key."""
    return stateful(_rows(stream), "key", ORDER, RESULT, lambda: Store(add, threshold, last, remember), step)


# -- duplicates by what rows are, with expiry -----------------------------------------------------


def first_rows_stream(stream: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The rows whose rounded vector has not come before: exact duplicates are left out, by Spark's own state.

    A vector is forgotten when the watermark passes its first row's time by `delay`; rows that come later than the
    watermark are dropped. The state has a row for each vector of that span.
    """
    return stream.withColumn("exact_key", fingerprints()[0]).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["exact_key"]).drop("exact_key")


def seen_before_stream(stream: DataFrame, what: str = "exact", delay: str = "1 hour") -> DataFrame:
    """(ts, id, exact_dup or bits_dup) of (ts, id, features): whether a row with the same rounded vector, or the same bit pattern, came before.

    The state is one time for each vector or pattern, the first row's, in the map of its bucket: a call of Python serves all
    keys of a bucket that a trigger brings, and looks up those alone. A timer at a bucket's earliest time clears what the
    watermark has passed by `delay`. Within a trigger the first row is the least by (ts, id), wherever it stands; rows later
    than the watermark are dropped.
    """
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    from gritsieve.streaming.keyed import milliseconds

    flag, span = f"{what}_dup", milliseconds(delay)
    name, kept, result = T.StructType.fromDDL("key string"), T.StructType.fromDDL("first_ms bigint"), T.StructType.fromDDL(f"ts timestamp, id bigint, {flag} boolean")

    class Seen(StatefulProcessor):
        def init(self, handle):
            self.handle, self.first = handle, handle.getMapState("first", name, kept)

        def handleInputRows(self, key, rows, timerValues):
            empty, known, held = not self.first.exists(), {}, None
            for pdf in rows:  # a bucket's rows come in parts; the least of each new key so far is held back
                for k in pdf["seen_key"].unique():
                    if k not in known:
                        known[k] = not empty and self.first.containsKey((k,))
                old = pdf["seen_key"].map(known).to_numpy(bool)
                yield pdf.loc[old, ["ts", "id"]].assign(**{flag: True})
                if not old.all():
                    fresh = pdf[~old] if held is None else pd.concat([held, pdf[~old]])
                    fresh = fresh.sort_values(["at_ms", "id"])
                    again = fresh.duplicated("seen_key")
                    yield fresh.loc[again, ["ts", "id"]].assign(**{flag: True})
                    held = fresh[~again]
            if held is not None:
                for k, ms in zip(held["seen_key"], held["at_ms"].tolist(), strict=True):
                    self.first.updateValue((k,), (ms,))
                self.wake(int(held["at_ms"].min()) + span)
                yield held[["ts", "id"]].assign(**{flag: False})

        def wake(self, at):
            """A bucket has one timer, its earliest."""
            timers = list(self.handle.listTimers())
            if not timers or at < min(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(at)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            limit, left = timerValues.getCurrentWatermarkInMs() - span, []
            for k, (ms,) in list(self.first.iterator()):
                if ms < limit:
                    self.first.removeKey(k)
                else:
                    left.append(ms)
            if left:
                self.handle.registerTimer(min(left) + span)
            return iter([])

        def close(self):
            pass

    column = F.coalesce(fingerprints()[0 if what == "exact" else 1], F.lit("")).alias("seen_key")
    rows = stream.select(column, F.col("ts").cast("timestamp"), F.unix_millis("ts").alias("at_ms"), F.col("id").cast("long")).withWatermark("ts", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("seen_key"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Seen(), outputStructType=result, outputMode="append", timeMode="eventTime")
