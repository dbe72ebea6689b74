"""Registered queries of the batch operators: sources, statistics, detectors, evaluation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed
from gritsieve.operators import detect as D, evaluate as E, forest as I, spectral as P
from gritsieve.plans import frames as X, reports as R
from gritsieve.sources import features as src, messages as M


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# -- sources ---------------------------------------------------------------


def s1_read_features(spark: SparkSession, d: str) -> DataFrame:
    return X.lineitem(spark, d).select("id", *[F.col("features")[k].alias(f"f{k}") for k in range(4)])


def s2_baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    return src.baseline_gate(X.lineitem(spark, d), 50)


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    e = X.embeddings(spark, d)
    n = F.size("features")
    return e.withColumn("features", F.when(F.col("id") % 7 == 0, F.slice("features", 1, n - 1)).when(F.col("id") % 11 == 0, F.concat(F.array(F.lit(float("nan"))), F.slice("features", 2, n - 1))).otherwise(F.col("features")))


def s3_validate_matrix(spark: SparkSession, d: str) -> DataFrame:
    return src.violations(_damaged(spark, d))


def s4_infer_features(spark: SparkSession, d: str) -> DataFrame:
    li = X.table(spark, d, "lineitem").select(X.line_id().alias("row"), *X.LINE_COLUMNS, F.col("l_returnflag").alias("label"), "l_linestatus")
    m = src.infer_features(li, "row")
    return m.select("id", F.size("features").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "label")


def messages(spark: SparkSession, d: str, key: str) -> DataFrame:
    """Queue messages made of `events`, some of them broken."""
    ev = X.table(spark, d, "events")
    data = F.when(F.col("event_id") % 17 == 0, F.array().cast("array<double>")).otherwise(F.array("value", F.col("user_id").cast("double")))
    good = F.to_json(F.struct(data.alias(key), F.col("event_type").alias("source"), F.col("user_id").alias("user")))
    value = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{broken "), F.col("event_type"))).otherwise(good)
    return ev.select(value.alias("value"), F.lit("in").alias("topic"), (F.col("event_id") % 4).alias("partition"), F.col("event_id").alias("offset"))


def parsed(p: DataFrame) -> DataFrame:
    return p.select("id", F.size("features").cast("bigint").alias("width"), F.col("features")[0].alias("first"), "source", F.col("metadata")["user"].alias("user"), "error")


def s5_parse_messages(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(M.parse_messages(messages(spark, d, "sample_data")))
    return p.withColumn("width", F.when(F.col("error").isNull(), F.col("width")))


def s6_parse_feature_events(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(M.parse_feature_events(messages(spark, d, "features")))
    return p.withColumn("width", F.when(F.col("error").isNull(), F.col("width")))


def s7_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return M.dead_letters(M.parse_messages(messages(spark, d, "sample_data"))).select("id", "error")


MESSAGES = """SELECT concat_ws(':', 'in', event_id % 4, event_id) AS id,
  CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN 2::BIGINT END AS width, CASE WHEN event_id % 13 <> 0 AND event_id % 17 <> 0 THEN value END AS first,
  CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE event_type END AS source, CASE WHEN event_id % 13 <> 0 THEN user_id::VARCHAR END AS user,
  CASE WHEN event_id % 13 = 0 THEN 'bad_json' WHEN event_id % 17 = 0 THEN 'bad_sample' END AS error FROM events"""

# -- statistics --------------------------------------------------------------


def a1_feature_moments(spark: SparkSession, d: str) -> DataFrame:
    return S.feature_moments(X.lineitem(spark, d)).select("j", r("mean"), r("std"))


def _quantiles(q: DataFrame) -> DataFrame:
    return q.select("j", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q25", "q50", "q75"))])


def a2_feature_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _quantiles(S.feature_quantiles(X.lineitem(spark, d)))


def a2_feature_quantiles_bracket(spark: SparkSession, d: str) -> DataFrame:
    return _quantiles(S.feature_quantiles(X.lineitem(spark, d), mode="bracket"))


_A2 = f"WITH {X.LI} SELECT j::INT AS j, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM lie GROUP BY j"


def a3_class_centroids(spark: SparkSession, d: str) -> DataFrame:
    return S.class_centroids(X.embeddings(spark, d)).select("label", F.posexplode("centroid").alias("j", "m")).select("label", "j", r("m"))


def a4_class_covariance(spark: SparkSession, d: str) -> DataFrame:
    m = X.embeddings(spark, d)
    g = S.class_scatter(m, S.class_means(m))
    at = g.select("label", "n", F.posexplode("gram").alias("at", "g"))
    return at.select("label", "n", F.floor(F.col("at") / 64).cast("int").alias("i"), (F.col("at") % 64).alias("j"), F.round(F.col("g") + 0.0, 6).alias("g"))


_A4 = f"""WITH {X.EMB}, c AS (SELECT label, j, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT e.id, e.label, e.j, c.n, x - m AS v FROM e JOIN c USING (label, j))
SELECT a.label, a.n, a.j::INT AS i, b.j::INT AS j, round(sum(a.v * b.v) + 0.0, 6) AS g FROM z a JOIN z b ON a.id = b.id AND a.label = b.label GROUP BY ALL"""


def a5_running_moments(spark: SparkSession, d: str) -> DataFrame:
    return S.running_moments(X.events(spark, d, "user_id"), "key", ["ts", "id"], "value").select("id", "n_before", r("mean_before", 10), r("std_before", 8))


_A5 = """SELECT event_id AS id, count(value) OVER w AS n_before, round(coalesce(avg(value) OVER w, 0), 10) AS mean_before, round(coalesce(stddev_samp(value) OVER w, 0), 8) AS std_before
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

# -- detectors -----------------------------------------------------------------

_Z = "m AS (SELECT j, avg(x) AS mu, stddev_pop(x) AS sd FROM {e} GROUP BY j), z AS (SELECT id, coalesce(max(CASE WHEN sd > 0 THEN abs(x - mu) / sd END), 0) AS z_score FROM {e} JOIN m USING (j) GROUP BY id)"
_Q = "q AS (SELECT j, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {e} GROUP BY j), o AS (SELECT id, coalesce(max(CASE WHEN q3 > q1 THEN greatest(0.0, (q1 - 1.5 * (q3 - q1) - x) / (q3 - q1), (x - q3 - 1.5 * (q3 - q1)) / (q3 - q1)) END), 0) AS iqr_score FROM {e} JOIN q USING (j) GROUP BY id)"


def d1_zscore(spark: SparkSession, d: str) -> DataFrame:
    return D.zscore_detect(X.lineitem(spark, d)).select("id", r("score"), "flagged")


def d1_zscore_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return D.zscore_detect(X.embeddings(spark, d)).select("id", r("score"), "flagged")


def d2_iqr(spark: SparkSession, d: str) -> DataFrame:
    return D.iqr_detect(X.lineitem(spark, d)).select("id", r("score"), "flagged")


def d2_iqr_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return D.iqr_detect(X.embeddings(spark, d)).select("id", r("score"), "flagged")


def d3_isolation_fit(spark: SparkSession, d: str) -> DataFrame:
    n = I.nodes(X.lineitem(spark, d))
    return n.select("tree", "node", "feature", r("split"), r("depth"))


def d4_isolation_score(spark: SparkSession, d: str) -> DataFrame:
    m = X.lineitem(spark, d)
    return I.trained(m).select("id", r("iso_score"), "iso_vote")


def d5_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return D.ensemble_vote(X.lineitem(spark, d)).select("id", r("anomaly_score"), "is_poisoned", "z_vote", "iqr_vote", "iso_vote")


def _uniform(what: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', 42, tree, node, '{what}')), 1, 12))::BIGINT / 281474976710656)"


def _drawn(rows: str) -> str:
    """Rows (tree, node, depth, f) with their node's size, feature and split; feature -1 in leaves."""
    ends = ", ".join(f"min(f[{j}]) OVER w AS a{j}, max(f[{j}]) OVER w AS b{j}" for j in range(1, 5))
    low, high = ("[" + ", ".join(f"{e}{j}" for j in range(1, 5)) + "]" for e in "ab")
    return f"""SELECT tree, node, depth, f, size, feature, CASE WHEN s >= {high}[feature + 1] THEN {low}[feature + 1] ELSE s END AS split FROM (
  SELECT *, {low}[feature + 1] + {_uniform("split")} * ({high}[feature + 1] - {low}[feature + 1]) AS s FROM (
    SELECT *, CASE WHEN depth >= top OR len(spread) = 0 THEN -1 ELSE spread[1 + floor({_uniform("feature")} * len(spread))::INT] END AS feature FROM (
      SELECT *, list_filter([0, 1, 2, 3], lambda j: {high}[j + 1] > {low}[j + 1]) AS spread FROM (
        SELECT *, count(*) OVER w AS size, {ends} FROM ({rows}) WINDOW w AS (PARTITION BY tree, node)))))"""


_C = "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} END"
_FOREST = f"""{X.LI},
pool AS MATERIALIZED (SELECT id, f FROM (SELECT id, f, row_number() OVER (ORDER BY md5('42:' || id)) AS k FROM li) WHERE k <= 25600),
sizes AS MATERIALIZED (SELECT least(m, 256) AS psi, greatest(1, m // 256) AS a_round, greatest(1, ceil(log2(greatest(least(m, 256), 2))))::INT AS top FROM (SELECT count(*) AS m FROM pool)),
dealt AS (SELECT round, f, row_number() OVER (PARTITION BY round ORDER BY md5(concat_ws(':', 42, round, id))) - 1 AS place FROM pool, (SELECT unnest(range((99 + a_round) // a_round)) AS round FROM sizes)),
roots AS MATERIALIZED (SELECT round * a_round + place // psi AS tree, f, top FROM dealt, sizes WHERE place // psi < a_round AND round * a_round + place // psi < 100),
grown(tree, node, depth, f, size, feature, split) AS (
  {_drawn("SELECT tree, 0 AS node, 0 AS depth, f, top FROM roots")}
  UNION ALL
  {_drawn("SELECT tree, CASE WHEN f[feature + 1] <= split THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, depth + 1 AS depth, f, top FROM grown, sizes WHERE feature >= 0")}),
nodes AS MATERIALIZED (SELECT DISTINCT tree, node, feature, CASE WHEN feature >= 0 THEN split ELSE 0.0 END AS split, CASE WHEN feature >= 0 THEN 0.0 ELSE depth + {_C.format(n="size")} END AS depth FROM grown)"""
_STEP = "CASE WHEN n{k}.feature < 0 THEN n{k}.node WHEN f[n{k}.feature + 1] <= n{k}.split THEN 2 * n{k}.node + 1 ELSE 2 * n{k}.node + 2 END"
_WALK = " ".join(f"JOIN nodes n{k} ON n{k}.tree = n0.tree AND n{k}.node = {_STEP.format(k=k - 1)}" for k in range(1, 9))
_SCORES = f"""{_FOREST},
raw AS MATERIALIZED (SELECT id, round(-pow(2.0, -avg(n8.depth) / any_value({_C.format(n="psi")})), 9) AS raw FROM sizes, li JOIN nodes n0 ON n0.node = 0 {_WALK} GROUP BY id),
ends AS (SELECT min(raw) AS low, max(raw) AS high, round(quantile_cont(raw, 0.1), 9) AS cut FROM raw),
iso AS (SELECT id, CASE WHEN high > low THEN (high - raw) / (high - low) ELSE 0.5 END AS iso_score, raw < cut AS iso_vote FROM raw, ends)"""


def d5_vote(spark: SparkSession, d: str) -> DataFrame:
    return D.decide(D.votes(X.embeddings(spark, d)), ["z_vote", "iqr_vote"], 2).select("id", "votes", "is_poisoned")


def d6_spectral(spark: SparkSession, d: str) -> DataFrame:
    return P.spectral_detect(X.shifted(spark, d)).select("id", "label", r("score"), r("threshold"), "flagged", "rank")


def _spectral_ctes(matrix: str) -> str:
    """Scores by repeated squaring of each class's scatter matrix, which tends to the top direction's projector."""
    ctes = [
        matrix,
        "e AS (SELECT id, label, unnest(range(len(f))) AS j, unnest(f) AS x FROM emb)",
        "c AS (SELECT label, j, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 5)",
        "z AS MATERIALIZED (SELECT e.id, e.label, e.j, x - m AS v FROM e JOIN c USING (label, j))",
        "g0 AS MATERIALIZED (SELECT a.label, a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM z a JOIN z b ON a.id = b.id GROUP BY ALL)",
    ]
    for k in range(14):
        ctes.append(f"n{k} AS (SELECT label, i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY label) AS v FROM g{k})")
        ctes.append(f"g{k + 1} AS MATERIALIZED (SELECT a.label, a.i, b.j, sum(a.v * b.v) AS v FROM n{k} a JOIN n{k} b ON a.label = b.label AND a.j = b.i GROUP BY ALL)")
    ctes.append("p AS (SELECT label, i, j, v / sum(CASE WHEN i = j THEN v ELSE 0 END) OVER (PARTITION BY label) AS v FROM g14)")
    ctes.append("y AS (SELECT z.id, z.label, p.j, sum(z.v * p.v) AS y FROM z JOIN p ON z.label = p.label AND z.j = p.i GROUP BY ALL)")
    ctes.append("s AS MATERIALIZED (SELECT z.id, z.label, sqrt(sum(z.v * y.y)) AS score FROM z JOIN y ON z.id = y.id AND z.j = y.j GROUP BY ALL)")
    return "WITH " + ",\n".join(ctes)


_D6_FOUND = "t AS (SELECT label, quantile_cont(score, 0.75) + 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) AS threshold FROM s GROUP BY label), found AS (SELECT id, s.label, score, threshold, score > threshold AS flagged FROM s JOIN t USING (label))"
_D6 = _spectral_ctes(X.SHIFT) + f", {_D6_FOUND} SELECT id, label, round(score, 6) AS score, round(threshold, 6) AS threshold, flagged, (row_number() OVER (PARTITION BY label ORDER BY score DESC, id))::INT AS rank FROM found"


def d6_class_stats(spark: SparkSession, d: str) -> DataFrame:
    m = X.shifted(spark, d)
    return P.class_stats(m, P.spectral_detect(m)).select("label", "n", "n_flagged", *[r(c) for c in ("threshold", "q1", "q3", "iqr", "mean_score", "max_score", "singular_value", "explained")], "skipped")


_D6_STATS = _spectral_ctes(X.SHIFT) + f""", {_D6_FOUND}, tr AS (SELECT label, sum(v * v) AS total FROM z GROUP BY label),
st AS (SELECT label, count(*) AS n, count_if(flagged)::BIGINT AS n_flagged, max(threshold) AS threshold, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, avg(score) AS mean_score, max(score) AS max_score, sum(score * score) AS top FROM found GROUP BY label)
SELECT label, n, n_flagged, round(threshold, 6) AS threshold, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, round(sqrt(top), 6) AS singular_value, round(top / total, 6) AS explained, false AS skipped FROM st JOIN tr USING (label)"""


def d7_label_flips_topk(spark: SparkSession, d: str) -> DataFrame:
    return P.label_flips_topk(X.shifted(spark, d)).select("id", "label", r("score"), r("threshold"), "flagged")


_D7 = _spectral_ctes(X.SHIFT) + ", t AS (SELECT label, quantile_cont(score, 0.95) AS threshold FROM s GROUP BY label) SELECT id, s.label, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS flagged FROM s JOIN t USING (label)"


def d8_label_flips_crossclass(spark: SparkSession, d: str) -> DataFrame:
    return P.label_flips_crossclass(X.shifted(spark, d)).select("id", "label", r("score"), "rank", "flagged")


_D8 = f"""WITH {X.SHIFT}, e AS (SELECT id, label, unnest(range(len(f))) AS j, unnest(f) AS x FROM emb), c AS (SELECT label, j, quantile_cont(x, 0.5) AS m FROM e GROUP BY ALL),
ds AS (SELECT e.id, e.label, c.label AS other, sqrt(sum((x - m) * (x - m))) AS d FROM e JOIN c USING (j) GROUP BY ALL),
s AS (SELECT id, label, max(CASE WHEN other = label THEN d END) - min(CASE WHEN other <> label THEN d END) AS score FROM ds GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM s)
SELECT id, label, round(score, 6) AS score, rank::INT AS rank, rank <= greatest(1, round_even(n * 0.05, 0)) AS flagged FROM k WHERE n >= 5"""


def d9_label_flips_robust(spark: SparkSession, d: str) -> DataFrame:
    return P.label_flips_robust(X.shifted(spark, d)).select("id", "label", r("score"), "rank", "flagged")


def d10_attribution(spark: SparkSession, d: str) -> DataFrame:
    a = D.attribution(X.lineitem(spark, d))
    return a.select("id", *[F.col("features_flagged")[k].alias(f"feature{k}") for k in range(3)], *[F.round(F.col("deviations")[k], 7).alias(f"deviation{k}") for k in range(3)])


_D10 = f"""WITH {X.LI}, m AS (SELECT j, avg(x) AS mu FROM lie GROUP BY j), a AS (SELECT id, j, abs(x - mu) AS dev, row_number() OVER (PARTITION BY id ORDER BY abs(x - mu) DESC, j) AS k FROM lie JOIN m USING (j))
SELECT id, max(CASE WHEN k = 1 THEN j END)::INT AS feature0, max(CASE WHEN k = 2 THEN j END)::INT AS feature1, max(CASE WHEN k = 3 THEN j END)::INT AS feature2,
round(max(CASE WHEN k = 1 THEN dev END), 7) AS deviation0, round(max(CASE WHEN k = 2 THEN dev END), 7) AS deviation1, round(max(CASE WHEN k = 3 THEN dev END), 7) AS deviation2 FROM a GROUP BY id"""


def d11_detect_zscore(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = D.detect(X.embeddings(spark, d), "zscore")
    return rows.select("id", r("anomaly_score"), "method", F.size("features_flagged").alias("n_features"), "is_poisoned")


_D11 = f"WITH {X.EMB}, {_Z.format(e='e')} SELECT id, CASE WHEN z_score >= 3 THEN round(z_score, 6) ELSE 0.0 END AS anomaly_score, 'zscore' AS method, CASE WHEN z_score >= 3 THEN 3 ELSE 0 END AS n_features, z_score >= 3 AS is_poisoned FROM z"


def d11_detect_summary(spark: SparkSession, d: str) -> DataFrame:
    _, s = D.detect(X.embeddings(spark, d), "iqr")
    return s.select("total_samples", "poisoned_count", F.col("method_scores")["iqr"].alias("iqr"))


_D11S = f"WITH {X.EMB}, {_Q.format(e='e')} SELECT count(*) AS total_samples, count_if(iqr_score > 0)::BIGINT AS poisoned_count, count_if(iqr_score > 0)::DOUBLE AS iqr FROM o"


def d12_scan_table(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings")
    value = lambda k: F.col("embedding")[k].cast("double") + F.when(F.col("label") == k, 0.5).otherwise(0.0)
    wide = e.select(F.col("vec_id").alias("id"), *[value(k).alias(f"f{k:02d}") for k in range(64)], "label")
    return D.scan_table(wide, "id").select("verdict", "n_rows", "n_flagged", F.array_join("flagged_ids", ",").alias("flagged_ids"))


_D12 = _spectral_ctes(X.SHIFT) + f", {_D6_FOUND}, fi AS (SELECT id FROM found WHERE flagged ORDER BY id LIMIT 50) SELECT CASE WHEN count_if(flagged) > 0 THEN 'POISON_SUSPECTED' ELSE 'clean' END AS verdict, count(*) AS n_rows, count_if(flagged)::BIGINT AS n_flagged, coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM fi), '') AS flagged_ids FROM found"

# -- evaluation ------------------------------------------------------------------

_MD = "md5(concat('7:', id::VARCHAR))"
_FLIP = f"emb0 AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f0 FROM embeddings), fl AS (SELECT *, row_number() OVER (PARTITION BY label = 0 ORDER BY {_MD}, id) AS rk, (SELECT floor(count(*) * 0.05) FROM emb0) AS k FROM emb0)"
_FLIPPED = f"{_FLIP}, emb AS (SELECT id, CASE WHEN label = 0 AND rk <= k THEN 1 ELSE label END AS label, label = 0 AND rk <= k AS is_flipped, list_transform(f0, lambda x, i: CASE WHEN i - 1 = label THEN x + 0.5 ELSE x END) AS f FROM fl)"


def _flipped(spark: SparkSession, d: str, fraction: float = 0.05) -> DataFrame:
    return E.inject_label_flips(X.shifted(spark, d), fraction)


def _crossclass(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = _flipped(spark, d)
    return m, P.label_flips_crossclass(m)


_D8_FLIPPED = f"""WITH {_FLIPPED}, e AS (SELECT id, label, unnest(range(len(f))) AS j, unnest(f) AS x FROM emb), c AS (SELECT label, j, quantile_cont(x, 0.5) AS m FROM e GROUP BY ALL),
ds AS (SELECT e.id, e.label, c.label AS other, sqrt(sum((x - m) * (x - m))) AS d FROM e JOIN c USING (j) GROUP BY ALL),
s AS (SELECT id, label, max(CASE WHEN other = label THEN d END) - min(CASE WHEN other <> label THEN d END) AS score FROM ds GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM s),
found AS (SELECT k.id, k.score, emb.is_flipped AS truth, rank <= greatest(1, round_even(n * 0.05, 0)) AS flagged FROM k JOIN emb USING (id))"""


def e1_confusion(spark: SparkSession, d: str) -> DataFrame:
    m, found = _crossclass(spark, d)
    return E.confusion(found.filter("flagged"), m.filter("is_flipped"))


_E1 = _D8_FLIPPED + """, n AS (SELECT count_if(flagged AND truth)::BIGINT AS tp, count_if(flagged AND NOT truth)::BIGINT AS fp, count_if(NOT flagged AND truth)::BIGINT AS fn FROM found)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM n"""


def _scored_truth(spark: SparkSession, d: str) -> DataFrame:
    m, found = _crossclass(spark, d)
    return found.join(m.select("id", F.col("is_flipped").alias("truth")), "id").select("id", F.round("score", 3).alias("score"), "truth")


def e2_rank_auc(spark: SparkSession, d: str) -> DataFrame:
    return E.rank_auc(_scored_truth(spark, d)).select(r("auc"))


_E2 = _D8_FLIPPED + """, a AS (SELECT round(score, 3) AS score, truth FROM found), p AS (SELECT p.score AS ps, n.score AS ns FROM a p JOIN a n ON p.truth AND NOT n.truth)
SELECT round(avg(CASE WHEN ps > ns THEN 1.0 WHEN ps = ns THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS auc FROM p"""


def e3_threshold_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    return E.threshold_at_fpr(_scored_truth(spark, d), 0.05).select(r("threshold"), r("fpr"), r("tpr"))


_E3 = _D8_FLIPPED + """, a AS (SELECT round(score, 3) AS score, truth FROM found), roc AS (SELECT t.score, (SELECT count(*) FROM a WHERE NOT truth AND a.score >= t.score) / (SELECT count(*) FROM a WHERE NOT truth) AS fpr,
(SELECT count(*) FROM a WHERE truth AND a.score >= t.score) / (SELECT count(*) FROM a WHERE truth) AS tpr FROM (SELECT DISTINCT score FROM a) t)
SELECT round(score, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc WHERE fpr <= 0.05 ORDER BY score LIMIT 1"""


def e4_fp_rate(spark: SparkSession, d: str) -> DataFrame:
    return E.fp_rate(_scored_truth(spark, d), 0.0).select(r("fp_rate"))


_E4 = _D8_FLIPPED + " SELECT round(count_if(NOT truth AND round(score, 3) >= 0) / count_if(NOT truth), 6) AS fp_rate FROM found"


def e5_inject_label_flips(spark: SparkSession, d: str) -> DataFrame:
    return _flipped(spark, d).select("id", "label", "is_flipped")


def e5_flip_binary(spark: SparkSession, d: str) -> DataFrame:
    m = X.embeddings(spark, d).withColumn("label", F.col("label") % 2)
    return E.flip_binary(m, 0.1).select("id", "label", "is_flipped")


_HASH8 = f"(('0x' || substr({_MD}, 1, 8))::BIGINT)"
_E5B = f"WITH b AS (SELECT vec_id AS id, label % 2 AS label FROM embeddings) SELECT id, CASE WHEN {_HASH8} < {int(0.1 * 2**32)} THEN 1 - label ELSE label END AS label, {_HASH8} < {int(0.1 * 2**32)} AS is_flipped FROM b"


def e6_inject_feature_shift(spark: SparkSession, d: str) -> DataFrame:
    m = E.inject_feature_shift(X.embeddings(spark, d), 0.1, 2.0, 3)
    return m.select("id", "is_poisoned", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_E6 = f"WITH b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings) SELECT id, {_HASH8} < {int(0.1 * 2**32)} AS is_poisoned, round(list_sum(f) + CASE WHEN {_HASH8} < {int(0.1 * 2**32)} THEN 6.0 ELSE 0.0 END, 6) AS total FROM b"


def e7_flip_groups(spark: SparkSession, d: str) -> DataFrame:
    return E.flip_groups(X.embeddings(spark, d), 20, 0.25).select("group_label", "id", "label", "is_flipped")


_E7 = f"""WITH b AS (SELECT vec_id AS id, label FROM embeddings), c AS (SELECT list(DISTINCT label ORDER BY label) AS labels, count(DISTINCT label) AS n, ceil(7.0 / (count(DISTINCT label) - 1))::BIGINT AS share FROM b),
k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_MD}, id) AS r FROM b),
p AS (SELECT id, label, r, share, n, labels, floor((r - 21) / share)::BIGINT + 1 AS step FROM k, c WHERE r <= 20 + share * (n - 1))
SELECT CASE WHEN r <= 20 THEN label ELSE labels[((list_position(labels, label) - 1 + step) % n + 1)::BIGINT] END AS group_label, id, label, r > 20 AS is_flipped FROM p WHERE r <= 20 OR (step - 1) * share + (r - 21) % share < 7"""


def e8_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_sample(X.embeddings(spark, d), 10).select("id", "label")


_E8 = f"WITH b AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, label FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_MD}, id) <= 10"


def e9_standardize(spark: SparkSession, d: str) -> DataFrame:
    return E.standardize(X.lineitem(spark, d)).select("id", *[F.round(F.col("features")[k] + 0.0, 6).alias(f"f{k}") for k in range(4)])


_E9 = f"WITH {X.LI}, m AS (SELECT j, avg(x) AS mu, stddev_pop(x) AS sd FROM lie GROUP BY j), z AS (SELECT id, j, round(CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END + 0.0, 6) AS z FROM lie JOIN m USING (j)) SELECT id, max(CASE WHEN j = 0 THEN z END) AS f0, max(CASE WHEN j = 1 THEN z END) AS f1, max(CASE WHEN j = 2 THEN z END) AS f2, max(CASE WHEN j = 3 THEN z END) AS f3 FROM z GROUP BY id"


def e9_standardize_pca(spark: SparkSession, d: str) -> DataFrame:
    out = E.standardize_pca(X.embeddings(spark, d), 3)
    return out.select("id", *[F.round(F.abs(F.col("features")[k]), 5).alias(f"p{k}") for k in range(3)])


def e10_per_class_eval(spark: SparkSession, d: str) -> DataFrame:
    out = E.per_class_eval(_flipped(spark, d), 0.05)
    return out.select("label", "n", "n_flipped", *[r(c) for c in ("mean_clean", "mean_flipped", "auc", "threshold", "fpr", "tpr", "fp_rate")])


_E10 = f"""WITH {_FLIPPED}, e AS (SELECT id, label, is_flipped, unnest(range(len(f))) AS j, unnest(f) AS x FROM emb), b AS (SELECT label, j, avg(x) AS mu, stddev_samp(x) AS sd FROM e WHERE NOT is_flipped GROUP BY ALL),
a AS (SELECT id, e.label, is_flipped AS truth, round(least(max(abs(x - mu) / CASE WHEN sd > 1e-10 THEN sd ELSE 1 END) / 6.0, 1.0), 6) AS score FROM e JOIN b ON e.label = b.label AND e.j = b.j GROUP BY ALL),
u AS (SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS auc FROM a p JOIN a n ON p.truth AND NOT n.truth),
roc AS (SELECT t.score, (SELECT count(*) FROM a WHERE NOT truth AND a.score >= t.score) / (SELECT count(*) FROM a WHERE NOT truth) AS fpr, (SELECT count(*) FROM a WHERE truth AND a.score >= t.score) / (SELECT count(*) FROM a WHERE truth) AS tpr FROM (SELECT DISTINCT score FROM a) t),
h AS (SELECT score AS threshold, fpr, tpr FROM roc WHERE fpr <= 0.05 ORDER BY score LIMIT 1)
SELECT label, count(*) AS n, count_if(truth)::BIGINT AS n_flipped, round(avg(score) FILTER (NOT truth), 6) AS mean_clean, round(avg(score) FILTER (truth), 6) AS mean_flipped, round(any_value(auc), 6) AS auc, round(any_value(threshold), 6) AS threshold, round(any_value(fpr), 6) AS fpr, round(any_value(tpr), 6) AS tpr, round(any_value(fpr), 6) AS fp_rate FROM a, u, h GROUP BY label"""


def _evaluated(out: DataFrame) -> DataFrame:
    return out.select("label", "n", "n_flipped", *[r(c) for c in ("mean_clean", "mean_flipped", "auc", "threshold", "fpr", "tpr", "fp_rate")])


def e10_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The keyed rule by class, z-score alone: a row past the threshold is flagged and not learned."""
    m = checkpointed(_flipped(spark, d))
    return _evaluated(E.per_class_eval(m, 0.05, scored=E.score_with_feedback(m, E10_THRESHOLD, 1, False)))


def e10_forest_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The keyed rule by class with a forest for each."""
    m = checkpointed(_flipped(spark, d))
    return _evaluated(E.per_class_eval(m, 0.05, scored=E.score_with_feedback(m, E10_THRESHOLD)))


#: A threshold that some rows of these tables pass.
E10_THRESHOLD = 2.5
_E10F = _E10.replace("WITH ", "WITH RECURSIVE ", 1)
_E10F = _E10F[: _E10F.index(", e AS (")] + f""", em AS MATERIALIZED (SELECT id, label, is_flipped, f, row_number() OVER (PARTITION BY label ORDER BY id) AS k, len(f) AS d FROM emb),
e AS (SELECT label, unnest(range(len(f))) AS j, unnest(f) AS x FROM em), b AS (SELECT label, list(mu ORDER BY j) AS mean, list(v ORDER BY j) AS m2, any_value(n) AS n FROM (SELECT label, j, avg(x) AS mu, var_pop(x) * count(x) AS v, count(x) AS n FROM e GROUP BY label, j) GROUP BY label),
s(label, k, id, truth, n, mean, m2, score) AS (
  SELECT label, 0::BIGINT, NULL::BIGINT, false, n, mean, m2, 0.0::DOUBLE FROM b
  UNION ALL
  SELECT label, k, id, truth, CASE WHEN bad THEN n ELSE n + 1 END, CASE WHEN bad THEN mean ELSE new END, CASE WHEN bad THEN m2 ELSE list_transform(m2, lambda v, i: v + (f[i] - mean[i]) * (f[i] - new[i])) END, CASE WHEN n >= 10 THEN least(z / {2 * E10_THRESHOLD}, 1.0) ELSE 0.0 END
  FROM (SELECT *, n >= 10 AND z > {E10_THRESHOLD} AS bad, list_transform(mean, lambda v, i: v + (f[i] - v) / (n + 1)) AS new FROM (
    SELECT em.label, em.k, em.id, em.is_flipped AS truth, em.f, s.n, s.mean, s.m2, list_max(list_transform(s.mean, lambda v, i: abs(em.f[i] - v) / CASE WHEN sqrt(s.m2[i] / (s.n - 1)) > 1e-10 THEN sqrt(s.m2[i] / (s.n - 1)) ELSE 1.0 END)) AS z
    FROM s JOIN em ON em.label = s.label AND em.k = s.k + 1))),
a AS (SELECT id, label, truth, round(score, 6) AS score FROM s WHERE k > 0),
""" + _E10F[_E10F.index("u AS (SELECT avg(") :]


def _f1_by_rate(spark: SparkSession, d: str) -> DataFrame:
    """(rate, method, f1) of three detectors at three rates of flips."""
    runs = {"crossclass": P.label_flips_crossclass, "topk": P.label_flips_topk}
    rows = None
    for rate in (0.05, 0.1, 0.2):
        m = checkpointed(E.inject_label_flips(X.shifted(spark, d), rate))
        truth = m.filter("is_flipped")
        flags = {name: run(m).filter("flagged") for name, run in runs.items()} | {"ensemble": D.ensemble_vote(m).filter("is_poisoned")}
        for name, flagged in flags.items():
            one = E.confusion(flagged, truth).select(F.lit(rate).alias("rate"), F.lit(name).alias("method"), "f1")
            rows = one if rows is None else rows.unionByName(one)
    return checkpointed(rows)


def e11_compare_methods(spark: SparkSession, d: str) -> DataFrame:
    """Cross-class distances against the ensemble at each rate, and the averages of all three detectors (rate null)."""
    rows = _f1_by_rate(spark, d)
    mean = E.averages(rows).select(F.lit(None).cast("double").alias("rate"), F.col("f1").alias("f1_first"), F.lit(None).cast("double").alias("f1_second"), F.lit(None).cast("double").alias("delta"), F.col("method").alias("winner"))
    return E.compare_methods(rows, "crossclass", "ensemble").unionByName(mean)


def e11_given_flags(spark: SparkSession, d: str) -> DataFrame:
    ev = X.table(spark, d, "events")
    f1 = ev.groupBy((F.col("user_id") % 5).cast("double").alias("rate"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("method")).agg(F.round(F.count_if(F.expr("value > 60")) / F.count("*"), 4).alias("f1"))
    return E.compare_methods(f1, "a", "b")


_E11 = """WITH t AS (SELECT (user_id % 5)::DOUBLE AS rate, round(count_if(value > 60 AND event_id % 2 = 0) / count_if(event_id % 2 = 0), 4) AS f1_first, round(count_if(value > 60 AND event_id % 2 = 1) / count_if(event_id % 2 = 1), 4) AS f1_second FROM events GROUP BY 1)
SELECT rate, f1_first, f1_second, round(f1_first - f1_second, 4) AS delta, CASE WHEN round(f1_first - f1_second, 4) > 0 THEN 'a' WHEN round(f1_first - f1_second, 4) < 0 THEN 'b' ELSE 'tie' END AS winner FROM t"""


def e12_triage_table(spark: SparkSession, d: str) -> DataFrame:
    m = _flipped(spark, d)
    return E.triage_table(P.spectral_detect(m), m).select("place", "id", "label", r("score"), r("threshold"), "flagged", "is_flipped")


_E12 = _spectral_ctes(_FLIPPED) + f", {_D6_FOUND} SELECT (row_number() OVER (ORDER BY score DESC, found.id))::INT AS place, found.id, found.label, round(score, 6) AS score, round(threshold, 6) AS threshold, flagged, is_flipped FROM found JOIN emb USING (id) ORDER BY score DESC, found.id LIMIT 20"

# -- reports -----------------------------------------------------------------------


def k1_report_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = D.decide(D.screen(X.embeddings(spark, d)), ["z_vote", "iqr_vote"], 2)
    return R.summary(rows, {"zscore": "z_vote", "iqr": "iqr_vote"})


_K1 = f"""WITH {X.EMB}, {_Z.format(e='e')}, {_Q.format(e='e')}, v AS (SELECT z_score >= 3 AS zv, iqr_score > 0 AS iv FROM z JOIN o USING (id)), n AS (SELECT count(*) AS n, count_if(zv AND iv) AS b, count_if(zv) AS zc, count_if(iv) AS ic FROM v)
SELECT 'total' AS item, n::DOUBLE AS value FROM n UNION ALL SELECT 'flagged', b FROM n UNION ALL SELECT 'rate_percent', round(100.0 * b / n, 2) FROM n UNION ALL SELECT 'method:zscore', zc FROM n UNION ALL SELECT 'method:iqr', ic FROM n"""


def _zscore_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(X.embeddings(spark, d), "zscore")[0]


def k2_export_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _zscore_rows(spark, d).select("id", "method", "is_poisoned")
    return R.as_json(rows)


_K2 = f"""WITH {X.EMB}, {_Z.format(e='e')} SELECT '{{"id":' || id || ',"method":"zscore","is_poisoned":' || (z_score >= 3)::VARCHAR || '}}' AS json FROM z"""


def k3_export_csv(spark: SparkSession, d: str) -> DataFrame:
    return R.as_csv(_zscore_rows(spark, d))


_K3 = f"WITH {X.EMB}, {_Z.format(e='e')} SELECT id AS sample_idx, format('{{:.6f}}', CASE WHEN z_score >= 3 THEN z_score ELSE 0.0 END) AS score, z_score >= 3 AS is_poisoned FROM z"


def k4_attribution_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.attribution_rows(D.attribution(X.lineitem(spark, d)), ["quantity", "extendedprice"], 7)


_K4 = f"""WITH {X.LI}, m AS (SELECT j, avg(x) AS mu FROM lie GROUP BY j), a AS (SELECT id, j, abs(x - mu) AS dev, row_number() OVER (PARTITION BY id ORDER BY abs(x - mu) DESC, j) - 1 AS place FROM lie JOIN m USING (j))
SELECT id, place::INT AS place, CASE j WHEN 0 THEN 'quantity' WHEN 1 THEN 'extendedprice' ELSE 'feature_' || j END AS feature, round(dev, 7) AS deviation FROM a WHERE place < 3"""

QUERIES = {
    "s1_read_features": (s1_read_features, f"WITH {X.LI} SELECT id, f[1] AS f0, f[2] AS f1, f[3] AS f2, f[4] AS f3 FROM li"),
    "s2_baseline_gate": (s2_baseline_gate, "SELECT count(*) AS n_rows, 0::BIGINT AS n_violations, count(*) >= 50 AS ready FROM lineitem"),
    "s3_validate_matrix": (s3_validate_matrix, "SELECT vec_id AS id, NULL::INT AS feature_idx, 'ragged' AS reason FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id, 0, 'not_finite' FROM embeddings WHERE vec_id % 11 = 0 AND vec_id % 7 <> 0"),
    "s4_infer_features": (s4_infer_features, "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS id, 4 AS width, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS total, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::INT AS label FROM lineitem"),
    "s5_parse_messages": (s5_parse_messages, MESSAGES),
    "s6_parse_feature_events": (s6_parse_feature_events, MESSAGES),
    "s7_dead_letters": (s7_dead_letters, f"SELECT id, error FROM ({MESSAGES}) WHERE error IS NOT NULL"),
    "a1_feature_moments": (a1_feature_moments, f"WITH {X.LI} SELECT j::INT AS j, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM lie GROUP BY j"),
    "a2_feature_quantiles": (a2_feature_quantiles, _A2),
    "a2_feature_quantiles_bracket": (a2_feature_quantiles_bracket, _A2),
    "a3_class_centroids": (a3_class_centroids, f"WITH {X.EMB} SELECT label, j::INT AS j, round(quantile_cont(x, 0.5), 6) AS m FROM e GROUP BY ALL"),
    "a4_class_covariance": (a4_class_covariance, _A4),
    "a5_running_moments": (a5_running_moments, _A5),
    "d1_zscore": (d1_zscore, f"WITH {X.LI}, {_Z.format(e='lie')} SELECT id, round(z_score, 6) AS score, z_score >= 3 AS flagged FROM z"),
    "d1_zscore_embeddings": (d1_zscore_embeddings, f"WITH {X.EMB}, {_Z.format(e='e')} SELECT id, round(z_score, 6) AS score, z_score >= 3 AS flagged FROM z"),
    "d2_iqr": (d2_iqr, f"WITH {X.LI}, {_Q.format(e='lie')} SELECT id, round(iqr_score, 6) AS score, iqr_score > 0 AS flagged FROM o"),
    "d2_iqr_embeddings": (d2_iqr_embeddings, f"WITH {X.EMB}, {_Q.format(e='e')} SELECT id, round(iqr_score, 6) AS score, iqr_score > 0 AS flagged FROM o"),
    "d3_isolation_fit": (d3_isolation_fit, f"WITH RECURSIVE {_FOREST} SELECT tree::INTEGER AS tree, node::INTEGER AS node, feature::INTEGER AS feature, round(split, 6) AS split, round(depth, 6) AS depth FROM nodes"),
    "d4_isolation_score": (d4_isolation_score, f"WITH RECURSIVE {_SCORES} SELECT id, round(iso_score, 6) AS iso_score, iso_vote FROM iso"),
    "d5_ensemble": (d5_ensemble, f"WITH RECURSIVE {_SCORES}, {_Z.format(e='lie')}, {_Q.format(e='lie')} SELECT id, round(iso_score, 6) AS anomaly_score, (z_score >= 3)::INT + (iqr_score > 0)::INT + iso_vote::INT >= 2 AS is_poisoned, z_score >= 3 AS z_vote, iqr_score > 0 AS iqr_vote, iso_vote FROM iso JOIN z USING (id) JOIN o USING (id)"),
    "d5_vote": (d5_vote, f"WITH {X.EMB}, {_Z.format(e='e')}, {_Q.format(e='e')} SELECT id, (z_score >= 3)::INT + (iqr_score > 0)::INT AS votes, z_score >= 3 AND iqr_score > 0 AS is_poisoned FROM z JOIN o USING (id)"),
    "d6_spectral": (d6_spectral, _D6),
    "d6_class_stats": (d6_class_stats, _D6_STATS),
    "d7_label_flips_topk": (d7_label_flips_topk, _D7),
    "d8_label_flips_crossclass": (d8_label_flips_crossclass, _D8),
    "d9_label_flips_robust": (d9_label_flips_robust, None),
    "d10_attribution": (d10_attribution, _D10),
    "d11_detect_zscore": (d11_detect_zscore, _D11),
    "d11_detect_summary": (d11_detect_summary, _D11S),
    "d12_scan_table": (d12_scan_table, _D12),
    "e1_confusion": (e1_confusion, _E1),
    "e2_rank_auc": (e2_rank_auc, _E2),
    "e3_threshold_at_fpr": (e3_threshold_at_fpr, _E3),
    "e4_fp_rate": (e4_fp_rate, _E4),
    "e5_inject_label_flips": (e5_inject_label_flips, f"WITH {_FLIPPED} SELECT id, label, is_flipped FROM emb"),
    "e5_flip_binary": (e5_flip_binary, _E5B),
    "e6_inject_feature_shift": (e6_inject_feature_shift, _E6),
    "e7_flip_groups": (e7_flip_groups, _E7),
    "e8_stratified_sample": (e8_stratified_sample, _E8),
    "e9_standardize": (e9_standardize, _E9),
    "e9_standardize_pca": (e9_standardize_pca, None),
    "e10_per_class_eval": (e10_per_class_eval, _E10),
    "e10_feedback": (e10_feedback, _E10F),
    "e10_forest_feedback": (e10_forest_feedback, None),
    "e11_compare_methods": (e11_compare_methods, None),
    "e11_given_flags": (e11_given_flags, _E11),
    "e12_triage_table": (e12_triage_table, _E12),
    "k1_report_summary": (k1_report_summary, _K1),
    "k2_export_json": (k2_export_json, _K2),
    "k3_export_csv": (k3_export_csv, _K3),
    "k4_attribution_rows": (k4_attribution_rows, _K4),
}
