"""Registered queries of the streaming forms: streams over files of the given tables, run trigger by trigger into tables that are then read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gritsieve.functions.cut import shared_folder
from gritsieve.operators import duplicates as U, monitor as N
from gritsieve.plans import batch as B, frames as X, sequences as Q
from gritsieve.plans.batch import r
from gritsieve.sources import messages as M
from gritsieve.streaming import consumer, refit as I, routing as O, scoring as T, store as K, watch as W

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state needs, for as long as a stream runs, in at most two parts for each core."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    mine = {_PROVIDER: _ROCKS, "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def in_triggers(rows: DataFrame, order: str, make: Callable[[DataFrame], DataFrame], n: int = 3, each: Callable[[DataFrame, int], None] | None = None, seen: Callable[[StreamingQuery], None] | None = None) -> str:
    """`make` over a stream of `rows`, which come in `n` runs by quantiles of `order`, one for each trigger; the folder of its results.

    The stream is stopped after every trigger and goes on from its checkpoint. `each` takes the results of a trigger
    instead of the table under `out`.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    bounds = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)])).first()[0] or []
    place = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(n):
        rows.filter(place == k).write.parquet(f"{folder}/in/{k}")
        stream = make(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in"))
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer = writer.foreachBatch(each) if each is not None else writer.format("parquet").option("path", f"{folder}/out")
        with _rocks(spark):
            query = writer.start()
            query.awaitTermination()
        if seen is not None:
            seen(query)
    return folder


def _out(rows: DataFrame, order: str, make: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    return rows.sparkSession.read.parquet(f"{in_triggers(rows, order, make, n)}/out")


def s8_stream_source(spark: SparkSession, d: str) -> DataFrame:
    """Messages as text files, read by the stream source and parsed on the way."""
    folder = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    B.messages(spark, d, "sample_data").select(F.to_json(F.struct("topic", "partition", "offset", "value")).alias("value")).write.text(f"{folder}/in")
    lines = M.stream_source(spark, "text", path=f"{folder}/in")
    record = F.from_json("value", "topic string, partition bigint, offset bigint, value string")
    parsed = M.parse_messages(lines.select(record.alias("m")).select("m.*"))
    query = parsed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = B.parsed(spark.read.parquet(f"{folder}/out"))
    return out.withColumn("width", F.when(F.col("error").isNull(), F.col("width")))


def t5_score_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful scorer; its rows are those of the static form."""
    return _out(Q.values(spark, d), "ts", lambda s: T.score_stream(s, least_votes=1)).select("key", "id", r("score"), "is_poisoned")


def t8_reset(spark: SparkSession, d: str) -> DataFrame:
    """Every 97th event clears its key's scorer."""
    rows = Q.values(spark, d).withColumn("reset", F.col("id") % 97 == 0)
    return _out(rows, "ts", lambda s: T.score_stream(s, least_votes=1)).select("key", "id", r("score"), "is_poisoned", "seen")


_T8 = Q.T5.replace("SELECT event_type AS key, event_id AS id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events", """SELECT event_type || ':' || part AS key, event_id AS id, value AS x, row_number() OVER (PARTITION BY event_type, part ORDER BY ts, event_id) AS k
  FROM (SELECT *, count_if(event_id % 97 = 0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS part FROM events) WHERE event_id % 97 <> 0""")


def t13_first_rows_stream(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, in units of the fourth decimal, whose like has not come before, by watermarked state that nothing here outlives.

    Of equal ones in a trigger any may be the row that is kept, so the vectors tell the result, not the ids.
    """
    rows = X.with_copies(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    out = _out(rows, "seq", lambda s: K.first_rows_stream(s, "1000 days"))
    return out.select(F.array_join(F.transform(U.rounded(), lambda x: F.round(x * 10_000).cast("bigint").cast("string")), ",").alias("vector"))


def t13_seen_before_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = X.with_copies(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    return _out(rows, "seq", lambda s: K.seen_before_stream(s, "exact", "1000 days")).select("id", "exact_dup")


def t14_seen_before_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = X.with_copies(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    return _out(rows, "seq", lambda s: K.seen_before_stream(s, "bits", "1000 days")).select("id", "bits_dup")


def t15_add_clean_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stateful store; its rows are those of the static form."""
    out = _out(Q.keyed_copies(spark, d), "seq", lambda s: K.look_up_and_add_stream(s, "clean", Q.NEAR, Q.KEPT, None))
    return out.select("key", "id", r("max_sim"), "exact_dup", "bits_dup", "near_dup", "added")


def t18_add_always_stream(spark: SparkSession, d: str) -> DataFrame:
    """The store into which every sample enters."""
    out = _out(Q.keyed_copies(spark, d), "seq", lambda s: K.look_up_and_add_stream(s, "always", Q.NEAR, Q.KEPT, None))
    return out.select("key", "id", r("max_sim"), "exact_dup", "bits_dup", "near_dup", "added")


def t4_refit(spark: SparkSession, d: str) -> DataFrame:
    """Five triggers of events, scored by the forest that the triggers before grew."""
    rows, folder = X.event_vectors(spark, d), f"{shared_folder(spark)}/refit-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/scored/trigger={n}")
    in_triggers(rows, "ts", lambda s: T.score_stream(s, forests=f"{folder}/forests"), 5, I.refit_sink(folder, write))
    return spark.read.parquet(f"{folder}/scored").select("trigger", "key", "id", r("score"), "is_poisoned", "z_vote", "iso_vote")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return X.event_flags(spark, d)


def m1_poison_rate_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed."""
    out = _out(_flags(spark, d), "ts", lambda s: N.poison_rate(s, "1 hour", delay="10 minutes"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "method", "seen", "flagged", r("rate"), "status")


_CLOSED = "date_trunc('hour', ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM fl) - INTERVAL 10 minute"
_M1 = f"""WITH {X.FLAGS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, method, count(*) AS seen, count_if(is_poisoned)::BIGINT AS flagged, round(count_if(is_poisoned) / count(*), 6) AS rate,
CASE WHEN count_if(is_poisoned) / count(*) > 0.2 THEN 'degraded' ELSE 'healthy' END AS status FROM fl WHERE {_CLOSED} GROUP BY date_trunc('hour', ts), method"""


def m2_bucket_histogram_stream(spark: SparkSession, d: str) -> DataFrame:
    out = _out(_flags(spark, d), "ts", lambda s: N.bucket_histogram(s, "value", [10.0, 50.0, 120.0], ["method"], "1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "method", "le", "n_cumulative", r("total"), "n")


_M2 = f"""WITH {X.FLAGS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, method, le, count_if(value <= le)::BIGINT AS n_cumulative, round(sum(value), 6) AS total, count(value) AS n
FROM fl, (SELECT unnest([10.0, 50.0, 120.0])::DOUBLE AS le) WHERE {_CLOSED} GROUP BY date_trunc('hour', ts), method, le"""


def _observed(rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, columns: list[str]) -> DataFrame:
    """Sums of the metrics that each trigger observed."""
    found: list[dict] = []
    in_triggers(rows, "ts", make, seen=lambda q: found.extend(W.recent_triggers(q, name)))
    one = rows.sparkSession.createDataFrame([tuple(f[c] for c in columns) for f in found], ", ".join(f"{c} bigint" for c in columns))  # a row for each trigger
    return one.agg(*[F.sum(c).alias(c) for c in columns])


def t7_observed_stats(spark: SparkSession, d: str) -> DataFrame:
    return _observed(_flags(spark, d), W.observe_scored, W.SCORED, ["seen", "poisoned", "refused"])


def t20_observed_stats(spark: SparkSession, d: str) -> DataFrame:
    return _observed(_flags(spark, d), lambda s: W.observe_routed(O.route(s)), W.ROUTED, ["consumed", "processed", "quarantined", "dead_lettered"])


def t19_consumer(spark: SparkSession, d: str) -> DataFrame:
    """Messages through the whole consumer, by the static form: parsed, scored, watched, looked up and routed."""
    parsed = M.parse_messages(B.messages(spark, d, "sample_data")).withColumn("ts", F.timestamp_seconds(F.split("id", ":")[2].cast("long")))
    return O.route(consumer.screen(parsed, scorer={"least_votes": 1})).select("id", "key", r("score"), "is_poisoned", "is_drifting", "duplicate", "error", "route")


QUERIES = {
    "s8_stream_source": (s8_stream_source, B.MESSAGES),
    "t4_refit": (t4_refit, None),
    "t5_score_stream": (t5_score_stream, Q.T5 + "SELECT key, id, round(score, 6) AS score, bad AS is_poisoned FROM s"),
    "t7_observed_stats": (t7_observed_stats, f"WITH {X.FLAGS} SELECT count_if(error IS NULL)::BIGINT AS seen, count_if(error IS NULL AND is_poisoned)::BIGINT AS poisoned, count_if(error IS NOT NULL)::BIGINT AS refused FROM fl"),
    "t8_reset": (t8_reset, _T8 + "SELECT split_part(key, ':', 1) AS key, id, round(score, 6) AS score, bad AS is_poisoned, k AS seen FROM s"),
    "t13_first_rows_stream": (t13_first_rows_stream, f"WITH {X.COPIES}, {Q.DUPS} SELECT array_to_string(list_transform(g, lambda v: round(v * 10000)::BIGINT), ',') AS vector FROM x JOIN k USING (id) WHERE NOT exact_dup"),
    "t13_seen_before_stream": (t13_seen_before_stream, f"WITH {X.COPIES}, {Q.DUPS} SELECT id, exact_dup FROM k"),
    "t14_seen_before_stream": (t14_seen_before_stream, f"WITH {X.COPIES}, {Q.BITS} SELECT id, row_number() OVER (PARTITION BY b ORDER BY id) > 1 AS bits_dup FROM b"),
    "t15_add_clean_stream": (t15_add_clean_stream, Q.STORE),
    "t18_add_always_stream": (t18_add_always_stream, Q.ALWAYS),
    "t19_consumer": (t19_consumer, None),
    "t20_observed_stats": (t20_observed_stats, f"WITH {X.FLAGS}, ro AS (SELECT {Q.ROUTE} FROM fl) SELECT count(*) AS consumed, count_if(route <> 'dead_letter')::BIGINT AS processed, count_if(route = 'quarantine')::BIGINT AS quarantined, count_if(route = 'dead_letter')::BIGINT AS dead_lettered FROM ro"),
    "m1_poison_rate_stream": (m1_poison_rate_stream, _M1),
    "m2_bucket_histogram_stream": (m2_bucket_histogram_stream, _M2),
}
