"""JSON messages as rows, on static and on streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

KNOWN = ("sample_data", "source", "timestamp")


def stream_source(spark: SparkSession, fmt: str = "kafka", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A stream: Kafka from the earliest offset, or files of a given schema. Offsets live in the query's checkpoint."""
    reader = spark.readStream.format(fmt).options(**({"startingOffsets": "earliest"} if fmt == "kafka" else {}) | options)
    return reader.schema(schema).load() if schema is not None else reader.load()


def message_id(df: DataFrame) -> Column:
    """topic:partition:offset where a queue supplied them."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("topic", "partition", "offset")])


def parse_messages(df: DataFrame, value_col: str = "value", id_col: str | None = None, data_key: str = "sample_data") -> DataFrame:
    """(id, features, source, ts, metadata, raw, error) of JSON messages.

    A message without a non-empty array under `data_key`, with an element that is
    no finite number, or that is no JSON at all has an error and null features.
    Other keys of the message become metadata, as text.
    """
    value = F.col(value_col).cast("string")
    keys = F.from_json(value, "map<string,string>")
    fields = F.from_json(value, f"`{data_key}` array<double>, source string, timestamp string")
    id_ = F.col(id_col).cast("string") if id_col else message_id(df)
    data = F.col("_f")[data_key]
    usable = F.coalesce((F.size(data) > 0) & ~F.exists(data, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    parsed = df.select("*", keys.alias("_k"), fields.alias("_f"))
    return parsed.select(
        id_.alias("id"),
        F.when(usable, data).alias("features"),
        F.coalesce(F.col("_f.source"), F.lit("unknown")).alias("source"),
        F.to_timestamp("_f.timestamp").alias("ts"),
        F.map_filter(F.coalesce("_k", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(data_key, *KNOWN)).alias("metadata"),
        value.alias("raw"),
        F.when(F.col("_k").isNull() | (F.map_contains_key("_k", F.lit("_corrupt_record"))), F.lit("bad_json")).when(~usable, F.lit("bad_sample")).alias("error"),
    )


def parse_feature_events(df: DataFrame, value_col: str = "value", id_col: str | None = None) -> DataFrame:
    """The variant whose vector stands under `features`."""
    return parse_messages(df, value_col, id_col, "features")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """(id, raw, error, ts) of the messages that could not be used."""
    return parsed.filter("error is not null").select("id", "raw", "error", "ts")
