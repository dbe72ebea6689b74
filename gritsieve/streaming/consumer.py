"""The whole consumer as one keyed operator: messages are parsed, scored, watched for drift, looked up among the kept ones, and routed.

A key's scorer, drift detector and store run over the same rows in one pass. Only samples that are neither poisoned nor
duplicates enter the store. Messages that cannot be used come out with their error, for the dead letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gritsieve.operators.forest import Forest
from gritsieve.streaming import drift as C, scoring as T, store as K
from gritsieve.streaming.keyed import Parts, in_order, stateful

ORDER = ["ts", "id"]
RESULT = "key string, ts timestamp, id string, source string, features array<double>, raw string, score double, is_poisoned boolean, is_drifting boolean, drift_score double, duplicate boolean, error string"


def _rows(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp"), F.col("id").cast("string"), F.col("source").cast("string"), F.col("features").cast("array<double>"), F.col("raw").cast("string"), "error", *K.fingerprints())


def _step(d: Parts, pdf: pd.DataFrame) -> pd.DataFrame:
    scorer, drift, store = d.parts["scorer"], d.parts["drift"], d.parts["store"]
    out = pdf[["key", *ORDER, "source", "features", "raw"]].copy()
    walked = T.Walked(pdf["features"])
    samples = walked.samples
    errors = [None if error is None or pd.isna(error) else error for error in pdf["error"]]
    whole = [i for i, error in enumerate(errors) if error is None]
    scored = scorer.run([samples[i] for i in whole], lambda k: walked.raw(scorer.forest, whole[k]))
    scores, poisoned = [None] * len(pdf), [False] * len(pdf)
    for i, score, bad, error in zip(whole, scored["score"], scored["is_poisoned"], scored["error"], strict=True):
        errors[i], scores[i], poisoned[i] = error, score, bad
    usable = [i for i in whole if errors[i] is None]
    moved = drift.run(np.stack([samples[i] for i in usable])) if usable else {"is_drifting": [], "drift_score": []}
    pick = lambda values: [values[i] for i in usable]
    found = store.run(pick(samples), pick(pdf["exact_key"].tolist()), pick(pdf["bit_pattern"].tolist()), pick(poisoned))
    drifting, level, duplicate = ([None] * len(pdf) for _ in range(3))
    for k, i in enumerate(usable):
        drifting[i], level[i], duplicate[i] = bool(moved["is_drifting"][k]), float(moved["drift_score"][k]), found[k][4]
    return out.assign(score=scores, is_poisoned=poisoned, is_drifting=drifting, drift_score=level, duplicate=duplicate, error=errors)


def _make(forest: Forest | None, scorer: dict, drift: dict, store: dict):
    return lambda: Parts(scorer=T.Scorer(forest=forest, **scorer), drift=C.ConceptDrift(**drift), store=K.Store("clean", **store))


def screen(parsed: DataFrame, key: str = "source", forest: Forest | None = None, scorer: dict | None = None, drift: dict | None = None, store: dict | None = None) -> DataFrame:
    """RESULT of parsed messages (see sources.messages), in order of (ts, id) within each key."""
    return in_order(_rows(parsed, key), "key", ORDER, RESULT, _make(forest, scorer or {}, drift or {}, store or {}), _step)


def screen_stream(parsed: DataFrame, key: str = "source", forest: Forest | None = None, scorer: dict | None = None, drift: dict | None = None, store: dict | None = None) -> DataFrame:
    """The stateful form; routing.sink takes its rows to clean, quarantine and dead-letter tables."""
    return stateful(_rows(parsed, key), "key", ORDER, RESULT, _make(forest, scorer or {}, drift or {}, {"remember": 100_000} | (store or {})), _step)
