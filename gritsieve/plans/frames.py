"""Frames that the registered queries share, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gritsieve.operators import evaluate as E
from gritsieve.sources import features as src

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

LI = "li AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS id, [l_quantity, l_extendedprice, l_discount, l_tax] AS f FROM lineitem), lie AS (SELECT id, unnest(range(4)) AS j, unnest(f) AS x FROM li)"
EMB = "emb AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f FROM embeddings), e AS (SELECT id, label, unnest(range(len(f))) AS j, unnest(f) AS x FROM emb)"
SHIFT = "emb AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i - 1 = label THEN x + 0.5 ELSE x END) AS f FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id() -> Column:
    """A key of `lineitem` rows: its key columns repeat, the price in cents tells those rows apart."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric columns of `lineitem` as a matrix."""
    df = table(spark, sf_dir, "lineitem")
    return src.pack(df, line_id(), LINE_COLUMNS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` with a class structure."""
    return E.shift_by_label(embeddings(spark, sf_dir), 0.5)


def events(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """(key, ts, id, value) of `events`."""
    return table(spark, sf_dir, "events").select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")


def event_vectors(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """(key, ts, id, features) with the value and the number in props."""
    df = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return df.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.array(F.col("value"), k).alias("features"))


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings`, then an exact copy of every fifth and a slightly changed copy of every seventh row, in sequence."""
    e = embeddings(spark, sf_dir).select("id", "features")
    exact = e.filter("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), "features")
    near = e.filter("id % 7 = 0").select((F.col("id") + 2_000_000).alias("id"), F.transform("features", lambda x, i: F.when(i == 0, x + 0.01).otherwise(x)).alias("features"))
    return e.unionByName(exact).unionByName(near).withColumn("seq", F.col("id"))


COPIES = """emb0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings),
emb AS (SELECT id, f FROM emb0 UNION ALL SELECT id + 1000000, f FROM emb0 WHERE id % 5 = 0
  UNION ALL SELECT id + 2000000, list_transform(f, lambda x, i: CASE WHEN i = 1 THEN x + 0.01 ELSE x END) FROM emb0 WHERE id % 7 = 0)"""


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given flags over `events`, for operators that take flags: (key, ts, id, method, is_poisoned, is_drifting, duplicate, error)."""
    df = table(spark, sf_dir, "events")
    return df.select(
        F.col("event_type").alias("key"), F.col("event_type").alias("method"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value",
        (F.col("value") > 120).alias("is_poisoned"), ((F.col("event_id") % 3) == 0).alias("is_drifting"), ((F.col("event_id") % 10) == 0).alias("duplicate"),
        F.when(F.col("event_id") % 13 == 0, F.lit("bad_json")).alias("error"), F.lit("queue").alias("source"), F.array("value").alias("features"),
    )


FLAGS = """fl AS (SELECT event_type AS key, event_type AS method, ts, event_id AS id, value, value > 120 AS is_poisoned, event_id % 3 = 0 AS is_drifting,
  event_id % 10 = 0 AS duplicate, CASE WHEN event_id % 13 = 0 THEN 'bad_json' END AS error, 'queue' AS source FROM events)"""
