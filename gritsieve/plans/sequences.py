"""Registered queries of the sequential operators: scoring, drift and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.operators import duplicates as U
from gritsieve.plans import frames as X
from gritsieve.plans.batch import r
from gritsieve.streaming import drift as C, routing as O, scoring as T, store as K


def t1_score_batch(spark: SparkSession, d: str) -> DataFrame:
    """With a forest from the key-free baseline."""
    from gritsieve.operators import forest as I

    v = X.event_vectors(spark, d)
    forest = I.fit(v.select("id", "features"), 0.05)
    return T.score_batch(v, forest).select("key", "id", r("score"), "is_poisoned", "z_vote", "iso_vote")


def t2_state_update(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each key entered the baseline."""
    s = T.score_batch(values(spark, d), least_votes=1)
    return s.groupBy("key").agg(F.count_if(F.expr("not is_poisoned")).alias("learned"), F.count_if("is_poisoned").alias("kept_out"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return X.events(spark, d).withColumn("features", F.array("value")).drop("value")


def t3_seed_baseline(spark: SparkSession, d: str) -> DataFrame:
    b = T.seed_baseline(values(spark, d))
    return b.select("key", "n", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.sqrt(F.col("m2")[0] / (F.col("n") - 1)), 6).alias("std"))


def t5_score_batch(spark: SparkSession, d: str) -> DataFrame:
    return T.score_batch(values(spark, d), least_votes=1).select("key", "id", r("score"), "is_poisoned")


T5 = """WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type AS key, event_id AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
s(key, k, id, n, mean, m2, score, bad) AS (
  SELECT key, k, id, 1::BIGINT, x, 0.0::DOUBLE, 0.0::DOUBLE, false FROM ev WHERE k = 1
  UNION ALL
  SELECT key, k, id, CASE WHEN bad THEN n ELSE n + 1 END, CASE WHEN bad THEN mean ELSE mean + (x - mean) / (n + 1) END,
    CASE WHEN bad THEN m2 ELSE m2 + (x - mean) * (x - (mean + (x - mean) / (n + 1))) END, CASE WHEN n >= 10 THEN least(z / 6.0, 1.0) ELSE 0.0 END, bad
  FROM (SELECT *, n >= 10 AND z > 3.0 AS bad FROM (
    SELECT ev.key, ev.k, ev.id, ev.x, s.n, s.mean, s.m2, CASE WHEN s.n >= 10 THEN abs(ev.x - s.mean) / CASE WHEN sqrt(s.m2 / (s.n - 1)) > 1e-10 THEN sqrt(s.m2 / (s.n - 1)) ELSE 1.0 END ELSE 0.0 END AS z
    FROM s JOIN ev ON ev.key = s.key AND ev.k = s.k + 1)))
"""


def t6_cold_start(spark: SparkSession, d: str) -> DataFrame:
    return T.cold_start(values(spark, d)).select("key", "id", r("score"), "is_poisoned", "z_vote")


_T6 = """SELECT key, id, CASE WHEN n >= 10 THEN round(least(z / 6.0, 1.0), 6) ELSE 0.0 END AS score, false AS is_poisoned, n >= 10 AND z > 3.0 AS z_vote FROM (
SELECT event_type AS key, event_id AS id, count(value) OVER w AS n, abs(value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 1e-10 THEN stddev_samp(value) OVER w ELSE 1.0 END AS z
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def t7_stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.stream_stats(X.event_flags(spark, d)).select("key", "seen", "poisoned", r("rate"))


def t9_adwin(spark: SparkSession, d: str) -> DataFrame:
    return C.adwin(X.events(spark, d)).select("key", "id", "drift")


def t10_page_hinkley(spark: SparkSession, d: str) -> DataFrame:
    return C.page_hinkley(X.events(spark, d, "user_id")).select("key", "id", "drift")


_T10 = """WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id::VARCHAR AS key, event_id AS id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s(key, k, id, mean, total, least_, hit) AS (
  SELECT key, k, id, x, -0.005::DOUBLE, -0.005::DOUBLE, false FROM ev WHERE k = 1
  UNION ALL
  SELECT key, k, id, mean, CASE WHEN hit THEN 0.0 ELSE total END, CASE WHEN hit THEN 'infinity'::DOUBLE ELSE low END, hit FROM (
    SELECT *, k > 30 AND total - low > 50.0 AS hit FROM (SELECT *, least(least_, total) AS low FROM (
      SELECT ev.key, ev.k, ev.id, 0.9999 * s.mean + (1 - 0.9999) * ev.x AS mean, s.total + (ev.x - (0.9999 * s.mean + (1 - 0.9999) * ev.x) - 0.005) AS total, s.least_
      FROM s JOIN ev ON ev.key = s.key AND ev.k = s.k + 1))))
SELECT key, id, hit AS drift FROM s"""


def t11_concept_drift(spark: SparkSession, d: str) -> DataFrame:
    return C.concept_drift(X.event_vectors(spark, d)).select("key", "id", "is_drifting", r("drift_score"), "features_drifting", "page_hinkley")


def _cut(w: str) -> str:
    """How many values the adaptive window `w` of n values drops: the first of three cuts whose means differ by the bound."""
    k = [f"greatest(5, floor(n * {share})::INT)" for share in (0.25, 0.5, 0.75)]
    hit = lambda k: f"{k} < n - 5 AND abs(list_avg({w}[1:{k}]) - list_avg({w}[{k} + 1:])) >= sqrt(ln(400.0) * (1.0 / {k} + 1.0 / (n - {k})) / 2)"
    return f"CASE WHEN n < 10 THEN 0 {' '.join(f'WHEN {hit(x)} THEN {x}' for x in k)} ELSE 0 END"


_SEQUENCE = "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events"
_T9 = f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type AS key, event_id AS id, value AS x, {_SEQUENCE}),
s(key, k, id, w, cut) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], 0::INT FROM ev
  UNION ALL
  SELECT key, k, id, w[cut + 1:], cut FROM (SELECT *, {_cut("w")} AS cut FROM (SELECT *, len(w) AS n FROM (SELECT ev.key, ev.k, ev.id, list_append(s.w, ev.x) AS w FROM s JOIN ev ON ev.key = s.key AND ev.k = s.k + 1))))
SELECT key, id, cut > 0 AS drift FROM s WHERE k > 0"""
_T11 = f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type AS key, event_id AS id, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y, {_SEQUENCE}),
s(key, k, id, w, v, c, d, mean, total, low, hit, distance) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], []::DOUBLE[], 0::INT, 0::INT, 0.0::DOUBLE, 0.0::DOUBLE, 'infinity'::DOUBLE, false, 0.0::DOUBLE FROM ev
  UNION ALL
  SELECT key, k, id, w[c + 1:], v[d + 1:], c, d, mean, CASE WHEN hit THEN 0.0 ELSE total END, CASE WHEN hit THEN 'infinity'::DOUBLE ELSE low END, hit, CASE WHEN hit THEN 0.0 ELSE total - low END
  FROM (SELECT *, k > 30 AND total - low > 50.0 AS hit FROM (SELECT * EXCLUDE (total, low), total, least(low, total) AS low FROM (SELECT * EXCLUDE (total), total + m - mean - 0.005 AS total FROM (
    SELECT * EXCLUDE (n, mean), CASE WHEN k = 1 THEN m ELSE 0.9999 * mean + (1 - 0.9999) * m END AS mean FROM (
    SELECT *, {_cut("v")} AS d FROM (SELECT * EXCLUDE (n), len(v) AS n FROM (SELECT *, {_cut("w")} AS c FROM (SELECT *, len(w) AS n FROM (
      SELECT ev.key, ev.k, ev.id, list_append(s.w, ev.x) AS w, list_append(s.v, ev.y) AS v, (ev.x + ev.y) / 2 AS m, s.mean, s.total, s.low FROM s JOIN ev ON ev.key = s.key AND ev.k = s.k + 1)))))))))
  )
SELECT key, id, ((c > 0)::INT + (d > 0)::INT) / 2 >= 0.3 OR hit AS is_drifting, round(least(1.0, greatest(distance / 50.0, ((c > 0)::INT + (d > 0)::INT) / 2 / 0.3)), 6) AS drift_score, (c > 0)::INT + (d > 0)::INT AS features_drifting, hit AS page_hinkley FROM s WHERE k > 0"""


def t12_drift_suppress(spark: SparkSession, d: str) -> DataFrame:
    f = X.event_flags(spark, d)
    return C.suppress(f.drop("is_drifting"), f.select("key", "id", "is_drifting")).select("key", "id", "is_poisoned", "is_drifting", "alert")


def t13_exact_dup(spark: SparkSession, d: str) -> DataFrame:
    return U.exact_duplicates(X.with_copies(spark, d), ["seq"]).select("id", "exact_dup")


_ROUNDED = "list_transform(f, lambda x: round_even(x, 4) + 0.0)"


def t14_phash_dup(spark: SparkSession, d: str) -> DataFrame:
    return U.pattern_duplicates(X.with_copies(spark, d), ["seq"]).select("id", "bits_dup")


BITS = f"b AS (SELECT id, array_to_string(list_transform(g, lambda x: CASE WHEN x - list_sum(g) / len(g) > 0 THEN '1' ELSE '0' END), '') AS b FROM (SELECT id, {_ROUNDED} AS g FROM emb))"


def t15_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return U.near_duplicates(X.with_copies(spark, d), "seq", 0.4, 1000).select("id", r("max_sim"), "near_dup")


_NEAR = """u AS (SELECT id, row_number() OVER (ORDER BY id) AS s, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS u FROM emb),
p AS (SELECT a.id, max(list_dot_product(a.u, b.u)) AS m FROM u a JOIN u b ON b.s < a.s AND b.s >= a.s - 1000 GROUP BY a.id)"""
_T15 = f"WITH {X.COPIES}, {_NEAR} SELECT u.id, round(greatest(0.0, coalesce(m, 0.0)), 6) AS max_sim, greatest(0.0, coalesce(m, 0.0)) >= 0.4 AS near_dup FROM u LEFT JOIN p USING (id)"


def t16_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = X.embeddings(spark, d)
    return U.max_similarity(e, e.filter("id % 20 = 0")).select("id", r("max_sim"))


_T16 = f"""WITH {X.EMB}, u AS (SELECT id, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS u FROM emb)
SELECT a.id, round(greatest(0.0, max(list_dot_product(a.u, b.u))), 6) AS max_sim FROM u a, u b WHERE b.id % 20 = 0 GROUP BY a.id"""


#: Threshold and vectors of the keyed stores, small enough for the store to overflow.
NEAR, KEPT = 0.4, 50


def keyed_copies(spark: SparkSession, d: str) -> DataFrame:
    """Copies in four keys, with some rows poisoned."""
    return X.with_copies(spark, d).select((F.col("id") % 4).cast("string").alias("key"), F.timestamp_seconds(F.col("seq") + 1000).alias("ts"), "id", "features", (F.col("id") % 11 == 3).alias("is_poisoned"), "seq")


def t15_add_clean(spark: SparkSession, d: str) -> DataFrame:
    """Only rows that are neither poisoned nor duplicates of the store enter it."""
    return K.look_up_and_add(keyed_copies(spark, d), "clean", NEAR, KEPT).select("key", "id", r("max_sim"), "exact_dup", "bits_dup", "near_dup", "added")


def t15_add_always(spark: SparkSession, d: str) -> DataFrame:
    """Every row enters the store."""
    return K.look_up_and_add(keyed_copies(spark, d), "always", NEAR, KEPT).select("key", "id", r("max_sim"), "exact_dup", "bits_dup", "near_dup", "added")


_KEYED = f"""rounded AS (SELECT id, f, {_ROUNDED} AS g FROM emb), {BITS},
y AS MATERIALIZED (SELECT (id % 4)::VARCHAR AS key, id, row_number() OVER (PARTITION BY id % 4 ORDER BY id) AS k, g::VARCHAR AS e, b.b AS bits, id % 11 = 3 AS bad, list_transform(f, lambda v: v / sqrt(list_sum(list_transform(f, lambda w: w * w)))) AS u FROM rounded JOIN b USING (id))"""
STORE = f"""WITH RECURSIVE {X.COPIES}, {_KEYED},
s(key, k, id, es, bs, ring, sim, exact_dup, bits_dup, near_dup, added) AS (
  SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, []::VARCHAR[], []::VARCHAR[], []::DOUBLE[][], 0.0::DOUBLE, false, false, false, false FROM y
  UNION ALL
  SELECT key, k, id, CASE WHEN added THEN list_append(es, e) ELSE es END, CASE WHEN added THEN list_append(bs, bits) ELSE bs END, CASE WHEN added THEN list_append(ring, u)[-{KEPT}:] ELSE ring END, sim, exact_dup, bits_dup, near_dup, added
  FROM (SELECT *, NOT (exact_dup OR bits_dup OR near_dup OR bad) AS added FROM (SELECT *, len(ring) > 0 AND NOT exact_dup AND NOT bits_dup AND sim >= {NEAR} AS near_dup FROM (
    SELECT y.*, s.es, s.bs, s.ring, list_contains(s.es, y.e) AS exact_dup, list_contains(s.bs, y.bits) AS bits_dup, greatest(0.0, coalesce(list_max(list_transform(s.ring, lambda v: list_dot_product(v, y.u))), 0.0)) AS sim
    FROM s JOIN y ON y.key = s.key AND y.k = s.k + 1))))
SELECT key, id, round(sim, 6) AS max_sim, exact_dup, bits_dup, near_dup, added FROM s WHERE k > 0"""
ALWAYS = f"""WITH {X.COPIES}, {_KEYED},
p AS (SELECT a.id, max(list_dot_product(a.u, c.u)) AS m FROM y a JOIN y c ON c.key = a.key AND c.k < a.k AND c.k >= a.k - {KEPT} GROUP BY a.id),
w AS (SELECT *, row_number() OVER (PARTITION BY key, e ORDER BY k) > 1 AS exact_dup, row_number() OVER (PARTITION BY key, bits ORDER BY k) > 1 AS bits_dup FROM y)
SELECT key, id, round(greatest(0.0, coalesce(m, 0.0)), 6) AS max_sim, exact_dup, bits_dup, coalesce(m >= {NEAR}, false) AND NOT exact_dup AND NOT bits_dup AS near_dup, true AS added FROM w LEFT JOIN p USING (id)"""


def t16_max_similarity_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same against references that come in blocks."""
    e = X.embeddings(spark, d)
    return U.max_similarity(e, e.filter("id % 20 = 0"), most=800).select("id", r("max_sim"))


def t17_fingerprint_stats(spark: SparkSession, d: str) -> DataFrame:
    return U.fingerprint_stats(U.duplicates(X.with_copies(spark, d), "seq", 0.4, 1000))


DUPS = f"x AS (SELECT id, {_ROUNDED} AS g FROM emb), k AS (SELECT id, row_number() OVER (PARTITION BY g ORDER BY id) > 1 AS exact_dup FROM x)"


def t18_add_samples(spark: SparkSession, d: str) -> DataFrame:
    e = X.embeddings(spark, d).select("id", "features", F.col("id").alias("seq"))
    kept = U.add_samples(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "seq", 300)
    return kept.select("id")


def t19_route(spark: SparkSession, d: str) -> DataFrame:
    return O.route(X.event_flags(spark, d)).select("id", "route")


ROUTE = "CASE WHEN error IS NOT NULL THEN 'dead_letter' WHEN is_poisoned OR duplicate THEN 'quarantine' ELSE 'clean' END AS route"


def t20_pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    return O.pipeline_stats(O.route(X.event_flags(spark, d)))


def k5_quarantine_sink(spark: SparkSession, d: str) -> DataFrame:
    rows = X.event_flags(spark, d).withColumn("score", F.col("value"))
    return O.quarantine_rows(rows).select("original_id", "source", "score")


QUERIES = {
    "t1_score_batch": (t1_score_batch, None),
    "t2_state_update": (t2_state_update, T5 + "SELECT key, count_if(NOT bad)::BIGINT AS learned, count_if(bad)::BIGINT AS kept_out FROM s GROUP BY key"),
    "t3_seed_baseline": (t3_seed_baseline, "SELECT event_type AS key, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1"),
    "t5_score_batch": (t5_score_batch, T5 + "SELECT key, id, round(score, 6) AS score, bad AS is_poisoned FROM s"),
    "t6_cold_start": (t6_cold_start, _T6),
    "t7_stream_stats": (t7_stream_stats, f"WITH {X.FLAGS} SELECT key, count(*) AS seen, count_if(is_poisoned)::BIGINT AS poisoned, round(count_if(is_poisoned) / count(*), 6) AS rate FROM fl GROUP BY key"),
    "t9_adwin": (t9_adwin, _T9),
    "t10_page_hinkley": (t10_page_hinkley, _T10),
    "t11_concept_drift": (t11_concept_drift, _T11),
    "t12_drift_suppress": (t12_drift_suppress, f"WITH {X.FLAGS} SELECT key, id, is_poisoned, is_drifting, is_poisoned AND NOT is_drifting AS alert FROM fl"),
    "t13_exact_dup": (t13_exact_dup, f"WITH {X.COPIES}, {DUPS} SELECT id, exact_dup FROM k"),
    "t14_phash_dup": (t14_phash_dup, f"WITH {X.COPIES}, {BITS} SELECT id, row_number() OVER (PARTITION BY b ORDER BY id) > 1 AS bits_dup FROM b"),
    "t15_near_dup": (t15_near_dup, _T15),
    "t15_add_clean": (t15_add_clean, STORE),
    "t15_add_always": (t15_add_always, ALWAYS),
    "t16_max_similarity": (t16_max_similarity, _T16),
    "t16_max_similarity_blocks": (t16_max_similarity_blocks, _T16),
    "t17_fingerprint_stats": (t17_fingerprint_stats, f"WITH {X.COPIES}, {DUPS}, {BITS}, {_NEAR}, bb AS (SELECT id, row_number() OVER (PARTITION BY b ORDER BY id) > 1 AS bits_dup FROM b), fl AS (SELECT exact_dup, bits_dup, coalesce(m, 0.0) >= 0.4 AS near FROM k JOIN bb USING (id) LEFT JOIN p USING (id)) SELECT count(*) AS seen, count_if(exact_dup)::BIGINT AS exact, count_if(bits_dup)::BIGINT AS patterns, count_if(near AND NOT exact_dup AND NOT bits_dup)::BIGINT AS near, count_if(exact_dup OR bits_dup OR near)::BIGINT AS duplicates FROM fl"),
    "t18_add_samples": (t18_add_samples, "SELECT vec_id AS id FROM embeddings ORDER BY vec_id DESC LIMIT 300"),
    "t19_route": (t19_route, f"WITH {X.FLAGS} SELECT id, {ROUTE} FROM fl"),
    "t20_pipeline_stats": (t20_pipeline_stats, f"WITH {X.FLAGS}, ro AS (SELECT {ROUTE} FROM fl) SELECT count(*) AS consumed, count_if(route <> 'dead_letter')::BIGINT AS processed, count_if(route = 'quarantine')::BIGINT AS quarantined, count_if(route = 'dead_letter')::BIGINT AS dead_lettered FROM ro"),
    "k5_quarantine_sink": (k5_quarantine_sink, f"WITH {X.FLAGS} SELECT id AS original_id, source, value AS score FROM fl WHERE error IS NULL AND (is_poisoned OR duplicate)"),
}
