"""Sharding by sampled splitters (operator 5), DataFrame functions only.

Keys are (MD5 of the text, id, place in the written table), so equal texts
are neighbours and yet any run of keys, even of equal rows, can be split.  A sample of keys, drawn with a chance in
proportion to the size of their rows, gives quantile boundaries of the bytes;
rows are range-partitioned by them, and ranges that turn out overfull are cut at quantiles of
samples drawn inside them, until none is.  Exact sums inside and before each range
place every row: a shard is a run of keys with its share of
all bytes.  Equal texts stay in one shard where a shard's end falls among them and they
have, together, no more bytes than the largest row; larger groups are split there.  Either
way a shard is at most the largest row's size off its share.

Nulls: a null text has size 8; null ids come first among equal texts.  Of rows that
repeat an id and a text, chance says which comes first, but each has its own slot.
Long texts are hashed whole and never moved.  Only the id and the text are read,
whatever other columns are called.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges for each shard, at least; and rows that a range should have at most on average.
RANGES_PER_SHARD = 8
RANGE_ROWS = 2_000_000
#: Sampled keys for each range.
SAMPLE_PER_RANGE = 24


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, hash of the text) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("h"),
    )


def _chance(seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64("key.h", "key.id", "key.row", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _rank(key: tuple) -> tuple:
    """Spark's order of keys: nulls first."""
    return key[0], key[1] is not None, key[1] or 0, key[2]


def _cuts(sample: DataFrame, by: list[str], pieces: Column | int) -> list:
    """Boundaries that cut each group's sampled keys into equal pieces, never below its first key; the boundaries alone reach the driver."""
    order = Window.partitionBy(*by).orderBy("key")
    ranked = sample.withColumns({"nth": F.row_number().over(order) - 1, "of": F.count("*").over(Window.partitionBy(*by))})
    piece = lambda n: F.floor(n * pieces / F.col("of"))
    found = ranked.filter((F.col("nth") > 0) & (piece(F.col("nth")) > piece(F.col("nth") - 1))).select("key.*")
    return [tuple(r) for r in found.collect()]


def _range_of(df: DataFrame, bounds: list) -> DataFrame:
    """`df` with the number of boundaries at or below each key, by binary search in a broadcast array."""
    if not bounds:
        return df.withColumn("range", F.lit(0))
    table = df.sparkSession.createDataFrame([(bounds,)], "bounds array<struct<h:string,id:bigint,row:bigint>>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.reduce(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= F.size("bounds")) & (F.get("bounds", low + step - 1) <= F.col("key")), low + step).otherwise(low))
    return df.crossJoin(F.broadcast(table)).withColumn("range", found).drop("bounds")  # one row; a key of 48 bytes for each range


def ranges(rows: DataFrame, n_shards: int) -> tuple[DataFrame, list]:
    """`rows` (key, size) with their range, and exact sums of each range, none of which is overfull.

    A range is overfull if its bytes beside its largest row pass twice the share of a range, or if it has twice as
    many rows as a range has on average and 2000 at least. Its sample is drawn with chances that give the rows beside
    the largest some 96 keys, or all of them, so that every round cuts it.
    """
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    all_bytes, n_ranges = total["bytes"] or 0, max(RANGES_PER_SHARD * n_shards, -(-total["n"] // RANGE_ROWS))
    share = all_bytes / n_ranges
    # the first sample is dealt by the first digits of the hash, in order: a part of it for about 64 ranges
    parts = max(1, n_ranges // 64)
    part = F.floor(F.conv(F.substr("key.h", F.lit(1), F.lit(8)), 16, 10).cast("long") * F.lit(parts) / float(1 << 32))
    sample = rows.filter(_chance(1) < F.col("size") * F.lit(n_ranges * SAMPLE_PER_RANGE / max(all_bytes, 1)))
    sample = sample.select("key", part.alias("part"))
    bounds = sorted(_cuts(sample, ["part"], F.greatest(F.lit(1), F.floor(F.col("of") / SAMPLE_PER_RANGE))), key=_rank)
    ranged, seed = _range_of(rows, bounds), 2
    sums = _sums(ranged)
    usual = max(total["n"] / n_ranges, 1000)
    while full := [(r["range"], float(r["bytes"] - r["most"]), int(max(r["bytes"] // share, r["rows"] // usual)) + 1) for r in sums if r["bytes"] - r["most"] > 2 * share or r["rows"] > 2 * usual]:
        table = rows.sparkSession.createDataFrame(full, "range int, others double, pieces int")  # at most half as many as there are shares
        inside = ranged.join(F.broadcast(table), "range").filter(_chance(seed) < F.col("size") * 4.0 * SAMPLE_PER_RANGE / F.col("others"))
        more = set(_cuts(inside.select("key", "range", "pieces"), ["range"], F.col("pieces"))) - set(bounds)
        if not more:
            break
        bounds, seed = sorted([*bounds, *more], key=_rank), seed + 1
        ranged = _range_of(rows, bounds)
        sums = _sums(ranged)
    return ranged, sums


def place(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with near-equal bytes in each shard."""
    from .storage import checkpointed

    spark = df.sparkSession
    rows = checkpointed(sized(df, id_col, text_col))  # some 60 bytes a row; texts are read once
    rows = rows.withColumn("key", F.struct("h", F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))).drop("h")
    ranged, sums = ranges(rows, n_shards)
    before, done, count = [], 0, 0
    for r in sums:
        before.append((r["range"], done, count))
        done, count = done + r["bytes"], count + r["rows"]
    largest = max((r["most"] for r in sums), default=0)
    starts = spark.createDataFrame(before, "range int, bytes_before bigint, rows_before bigint")  # a row for each range
    order = Window.partitionBy("range").orderBy("key")
    placed = ranged.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(order)})
    placed = placed.join(F.broadcast(starts), "range").select(
        "doc_id", "size", "text_crc32", F.col("key.h").alias("h"),
        (F.col("bytes_before") + F.col("upto")).alias("end"),
        (F.col("rows_before") + F.col("nth") - 1).alias("index"),
    )
    placed = checkpointed(placed)
    shard_at = lambda at: F.least(F.floor(at * n_shards / F.lit(max(done, 1))), F.lit(n_shards - 1)).cast("int")
    own = shard_at(F.col("end") - F.floor(F.col("size") / 2))
    # a row for each shard's end that falls inside a group of equal texts
    at_ends = placed.filter(F.floor((F.col("end") - F.col("size")) * n_shards / F.lit(max(done, 1))) < F.floor(F.col("end") * n_shards / F.lit(max(done, 1)))).select("h").distinct()
    groups = placed.join(F.broadcast(at_ends), "h", "left_semi").groupBy("h").agg(F.min(F.col("end") - F.col("size")).alias("a"), F.max("end").alias("b"))
    whole = groups.filter(F.col("b") - F.col("a") <= largest).select("h", shard_at(F.floor((F.col("a") + F.col("b")) / 2)).alias("whole"))
    placed = placed.join(F.broadcast(whole), "h", "left").withColumn("shard", F.coalesce("whole", own))
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _sums(ranged: DataFrame) -> list:
    """Exact bytes and rows of each range, in order; a row for each range comes to the driver."""
    return ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")).orderBy("range").collect()
