"""Windowed rates, histograms and alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SEVERITIES = ("info", "warning", "critical", "page")
COOLDOWN, ESCALATION = 300.0, 900.0


def in_time(rows: DataFrame, delay: str | None) -> DataFrame:
    """A stream with a watermark `delay` behind its newest event; static rows and streams without a delay as they are."""
    return rows.withWatermark("ts", delay) if rows.isStreaming and delay else rows


def poison_rate(flags: DataFrame, window: str = "1 hour", by: str = "method", least_rate: float = 0.2, latency_col: str | None = None, baseline_ready: bool = True, delay: str | None = "10 minutes") -> DataFrame:
    """(window_start, by, seen, flagged, rate, status) of tumbling windows over (ts, by, is_poisoned).

    On a stream in append mode a window comes out once the watermark has passed its end, and rows later than that are
    dropped; how many rows fell out so each trigger's progress tells (see streaming.watch). The state has a row for each
    open window and group.
    """
    flags = in_time(flags, delay)
    latency = [F.avg(latency_col).alias("latency_ms")] if latency_col else []
    out = flags.groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("seen"), F.count_if("is_poisoned").alias("flagged"), *latency)
    rate = F.col("flagged") / F.col("seen")
    status = F.when((rate > least_rate) | F.lit(not baseline_ready), "degraded").otherwise("healthy")
    if latency_col:
        status = F.when(F.col("latency_ms") > 1000, "unhealthy").otherwise(status)
    return out.select(F.col("w.start").alias("window_start"), by, "seen", "flagged", rate.alias("rate"), status.alias("status"))


def bucket_histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None, window: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """(by, le, n_cumulative, total, n): cumulative counts at fixed bounds in one aggregate.

    With a window also window_start: tumbling windows of `ts`, on streams with a watermark as in poison_rate.
    """
    if window:
        df = in_time(df, delay).withColumn("_w", F.window("ts", window))
        out = bucket_histogram(df, value, bounds, [*(by or []), "_w"])
        return out.withColumn("window_start", F.col("_w.start")).drop("_w")
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n_cumulative")) for b in bounds]
    out = df.groupBy(*(by or [])).agg(F.array(*counts).alias("h"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return out.select(*(by or []), F.explode("h").alias("h"), "total", "n").select(*(by or []), "h.le", "h.n_cumulative", "total", "n")


def alert_candidates(rates: DataFrame, limit: float = 0.1, by: str = "method") -> DataFrame:
    """Alert rows for windows whose rate passes the limit; drift flags come in by the same shape."""
    title = F.concat(F.lit("Poison rate high: "), F.col(by))
    return rates.filter(F.col("rate") > limit).select(F.lit("POISON_RATE_HIGH").alias("type"), F.lit("warning").alias("severity"), title.alias("title"), F.col("window_start").alias("ts"), F.concat_ws(":", F.lit("POISON_RATE_HIGH"), title).alias("dedup_key"))


def drift_alerts(drift: DataFrame) -> DataFrame:
    """Alert rows of (key, ts, is_drifting)."""
    title = F.concat(F.lit("Drift: "), F.col("key").cast("string"))
    return drift.filter("is_drifting").select(F.lit("DRIFT_DETECTED").alias("type"), F.lit("info").alias("severity"), title.alias("title"), "ts", F.concat_ws(":", F.lit("DRIFT_DETECTED"), title).alias("dedup_key"))


def step(state: list[float] | None, ts: float, level: int, cooldown: float, escalation: float, reset_after: float | None) -> tuple[list[float], bool, int]:
    """One alert of a key: new state (first seen, last sent), whether it is sent, and its level."""
    if state is None or (reset_after is not None and ts - state[1] >= reset_after):
        return [ts, ts], True, level
    if ts - state[1] < cooldown:
        return state, False, level
    age = ts - state[0]
    new = 3 if age > 2 * escalation else 2 if age > escalation else level
    return [state[0], ts], True, max(level, new)


def _alerts(alerts: DataFrame, cooldown: float, escalation: float, reset_after: float | None, streaming: bool) -> DataFrame:
    from gritsieve.streaming.keyed import Detector, in_order, stateful

    class Sent(Detector):
        """When a key was first seen and last sent."""

        VALUES = {"sent": "first double, last double"}

        def __init__(self):
            self.times: list[float] | None = None

        def values(self) -> dict[str, tuple]:
            return {"sent": tuple(self.times)} if self.times else {}

        def restore(self, values: dict, logs: dict, maps: dict) -> None:
            self.times = list(values["sent"]) if "sent" in values else None

    rank = {s: i for i, s in enumerate(SEVERITIES)}

    def run(held: Sent, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in pdf.itertuples(index=False):
            level = rank[a.severity]
            held.times, sent, new = step(held.times, a.ts, level, cooldown, escalation, reset_after)
            up = new > level
            out.append((a.dedup_key, a.ts, a.id, f"[ESCALATED] {a.title}" if up else a.title, SEVERITIES[new], sent, a.severity if up else None))
        return pd.DataFrame(out, columns=["dedup_key", "ts", "id", "title", "severity", "sent", "escalated_from"])

    rows = alerts.select("dedup_key", F.col("ts").cast("double").alias("ts"), F.col("id").cast("long").alias("id"), "title", "severity")
    schema = "dedup_key string, ts double, id bigint, title string, severity string, sent boolean, escalated_from string"
    return (stateful if streaming else in_order)(rows, "dedup_key", ["ts", "id"], schema, Sent, run)


def alert_dedup(alerts: DataFrame, cooldown: float = COOLDOWN, escalation: float = ESCALATION, reset_after: float | None = None) -> DataFrame:
    """(dedup_key, ts, id, title, severity, sent, escalated_from): suppression within the cooldown, escalation by age."""
    return _alerts(alerts, cooldown, escalation, reset_after, False)


def alert_dedup_stream(stream: DataFrame, cooldown: float = COOLDOWN, escalation: float = ESCALATION, reset_after: float | None = None) -> DataFrame:
    """The stateful form: two times of state for each key."""
    return _alerts(stream, cooldown, escalation, reset_after, True)


def recent_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The newest alerts."""
    return alerts.orderBy(F.desc("ts"), "dedup_key", *(["id"] if "id" in alerts.columns else [])).limit(limit)
