"""Registered queries of the review and monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.operators import monitor as N, review as Q
from gritsieve.plans import frames as X
from gritsieve.plans.batch import r


def _log(spark: SparkSession, d: str) -> DataFrame:
    flagged = X.event_flags(spark, d).filter("is_poisoned")
    return Q.append(flagged.select("id", "features", F.create_map(F.lit("zscore"), F.col("value")).alias("scores"), "ts", "source"))


def _resolutions(spark: SparkSession, d: str) -> DataFrame:
    f = X.event_flags(spark, d).filter("id % 4 = 0")
    sample = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("source")))
    first = f.select(sample.alias("sample_id"), F.lit("confirmed_poison").alias("status"), F.lit("ann").alias("reviewer"), F.lit("").alias("notes"), F.col("ts").alias("resolved_at"))
    later = f.filter("id % 8 = 0").select(sample.alias("sample_id"), F.lit("false_positive").alias("status"), F.lit("bob").alias("reviewer"), F.lit("second look").alias("notes"), (F.col("ts") + F.expr("interval 1 hour")).alias("resolved_at"))
    return first.unionByName(later)


_LOG = f"{X.FLAGS}, lg AS (SELECT md5(concat_ws('|', id, source)) AS sample_id, id AS original_id, ts, source FROM fl WHERE is_poisoned)"
_STATE = f"{_LOG}, cur AS (SELECT *, CASE WHEN original_id % 8 = 0 THEN 'false_positive' WHEN original_id % 4 = 0 THEN 'confirmed_poison' ELSE 'pending' END AS status, CASE WHEN original_id % 8 = 0 THEN 'bob' WHEN original_id % 4 = 0 THEN 'ann' END AS reviewer FROM lg)"


def q1_quarantine_append(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("sample_id", "original_id", "source", "status")


def _current(spark: SparkSession, d: str) -> DataFrame:
    return Q.latest(_log(spark, d), _resolutions(spark, d))


def q2_quarantine_get(spark: SparkSession, d: str) -> DataFrame:
    """The sample with the least id, looked up by its own id."""
    current = _current(spark, d)
    key = _log(spark, d).agg(F.min("sample_id").alias("sample_id"))
    return current.join(F.broadcast(key), "sample_id", "left_semi").select("sample_id", "original_id", "status")


def q3_pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    return Q.pending(_current(spark, d), 100).select("sample_id", "original_id", "status")


def q4_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("sample_id", "status", "reviewer")


def q4_unknown_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return Q.unknown_resolutions(_log(spark, d), _resolutions(spark, d)).select("sample_id", "status")


_Q4U = f"WITH {_LOG} SELECT md5(concat_ws('|', id, source)) AS sample_id, 'confirmed_poison' AS status FROM fl WHERE id % 4 = 0 AND NOT is_poisoned UNION ALL SELECT md5(concat_ws('|', id, source)), 'false_positive' FROM fl WHERE id % 8 = 0 AND NOT is_poisoned"


def q5_quarantine_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.stats(_current(spark, d))


_Q5 = f"WITH {_STATE} SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'confirmed_poison')::BIGINT AS confirmed, count_if(status = 'false_positive')::BIGINT AS false_positives, coalesce(strftime(min(CASE WHEN status = 'pending' THEN ts END), '%Y-%m-%dT%H:%M:%S'), '') AS oldest_pending FROM cur"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return N.poison_rate(X.event_flags(spark, d), "1 hour")


def m1_poison_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select(F.unix_timestamp("window_start").alias("window_start"), "method", "seen", "flagged", r("rate"), "status")


_RATES = f"{X.FLAGS}, rt AS (SELECT date_trunc('hour', ts) AS w, method, count(*) AS seen, count_if(is_poisoned)::BIGINT AS flagged, count_if(is_poisoned) / count(*) AS rate FROM fl GROUP BY ALL)"
_M1 = f"WITH {_RATES} SELECT epoch(w)::BIGINT AS window_start, method, seen, flagged, round(rate, 6) AS rate, CASE WHEN rate > 0.2 THEN 'degraded' ELSE 'healthy' END AS status FROM rt"
_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


def m2_bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return N.bucket_histogram(X.event_flags(spark, d), "value", _BOUNDS, ["method"]).select("method", "le", "n_cumulative", r("total", 4), "n")


_M2 = f"WITH {X.FLAGS} SELECT method, le, count_if(value <= le)::BIGINT AS n_cumulative, round(sum(value), 4) AS total, count(*) AS n FROM fl, (SELECT unnest({_BOUNDS})::DOUBLE AS le) GROUP BY method, le"


def m3_alert_candidates(spark: SparkSession, d: str) -> DataFrame:
    return N.alert_candidates(_rates(spark, d)).select("type", "severity", "title", F.unix_timestamp("ts").alias("ts"), "dedup_key")


_M3 = f"WITH {_RATES} SELECT 'POISON_RATE_HIGH' AS type, 'warning' AS severity, 'Poison rate high: ' || method AS title, epoch(w)::BIGINT AS ts, 'POISON_RATE_HIGH:Poison rate high: ' || method AS dedup_key FROM rt WHERE rate > 0.1"


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    ev = X.table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return ev.select(F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("dedup_key"), seconds.alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.when(F.col("value") > 100, "critical").otherwise("warning").alias("severity"))


def m4_alert_dedup(spark: SparkSession, d: str) -> DataFrame:
    return N.alert_dedup(_alerts(spark, d), 3600.0, 200_000.0).select("dedup_key", "id", "title", "severity", "sent", "escalated_from")


_M4 = """WITH RECURSIVE al AS MATERIALIZED (SELECT concat_ws(':', event_type, user_id % 10) AS key, epoch_us(ts) / 1e6 AS t, event_id AS id, event_type AS title, CASE WHEN value > 100 THEN 2 ELSE 1 END AS lv,
  row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) AS k FROM events),
s(key, k, id, title, first, last, sent, lv, new) AS (
  SELECT key, k, id, title, t, t, true, lv, lv FROM al WHERE k = 1
  UNION ALL
  SELECT al.key, al.k, al.id, al.title, s.first, CASE WHEN al.t - s.last >= 3600 THEN al.t ELSE s.last END, al.t - s.last >= 3600, al.lv,
    CASE WHEN al.t - s.last < 3600 THEN al.lv WHEN al.t - s.first > 400000 THEN 3 WHEN al.t - s.first > 200000 THEN greatest(al.lv, 2) ELSE al.lv END
  FROM s JOIN al ON al.key = s.key AND al.k = s.k + 1)
SELECT key AS dedup_key, id, CASE WHEN new > lv THEN '[ESCALATED] ' || title ELSE title END AS title, ['info', 'warning', 'critical', 'page'][new + 1] AS severity, sent, CASE WHEN new > lv THEN ['info', 'warning', 'critical', 'page'][lv + 1] END AS escalated_from FROM s"""


def m5_recent_alerts(spark: SparkSession, d: str) -> DataFrame:
    return N.recent_alerts(_alerts(spark, d), 50).select("dedup_key", "id")


QUERIES = {
    "q1_quarantine_append": (q1_quarantine_append, f"WITH {_LOG} SELECT sample_id, original_id, source, 'pending' AS status FROM lg"),
    "q2_quarantine_get": (q2_quarantine_get, f"WITH {_STATE} SELECT sample_id, original_id, status FROM cur ORDER BY sample_id LIMIT 1"),
    "q3_pending_reviews": (q3_pending_reviews, f"WITH {_STATE} SELECT sample_id, original_id, status FROM cur WHERE status = 'pending' ORDER BY ts, sample_id LIMIT 100"),
    "q4_resolve": (q4_resolve, f"WITH {_STATE} SELECT sample_id, status, reviewer FROM cur"),
    "q4_unknown_resolutions": (q4_unknown_resolutions, _Q4U),
    "q5_quarantine_stats": (q5_quarantine_stats, _Q5),
    "m1_poison_rate": (m1_poison_rate, _M1),
    "m2_bucket_histogram": (m2_bucket_histogram, _M2),
    "m3_alert_candidates": (m3_alert_candidates, _M3),
    "m4_alert_dedup": (m4_alert_dedup, _M4),
    "m5_recent_alerts": (m5_recent_alerts, "SELECT concat_ws(':', event_type, user_id % 10) AS dedup_key, event_id AS id FROM events ORDER BY ts DESC, dedup_key LIMIT 50"),
}
