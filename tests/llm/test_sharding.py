"""Sharding against a plain version: balance, gapless slots, groups of equal texts, ranges that are cut until none is overfull."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gritsieve.llm import sharding as D

SCHEMA = "doc_id bigint, text string"


def check(rows, out, n):
    """Every row once, slots without gaps, shards within the largest row of their share, small groups whole."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    sums, slots, texts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most, total = max(size(t) for _, t in rows), sum(size(t) for _, t in rows)
    assert set(sums) <= set(range(n)) and all(abs(sums[s] - total / n) <= most + 1 for s in range(n))
    copies = collections.Counter((size(t), zlib.crc32((t or "").encode())) for _, t in rows)
    assert all(len(shards) == 1 for k, shards in texts.items() if copies[k] * k[0] <= most)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], D.place(docs, 24).collect(), 24)


def test_few_long_texts(spark):
    """Long texts, of which a range holds a handful at most."""
    rng = random.Random(3)
    rows = [(i, chr(97 + i % 26) * rng.choice([100_000, 300_000, 1_000_000])) for i in range(5)] + [(None, None), (9, ""), (9, "")]
    check(rows, D.place(spark.createDataFrame(rows, SCHEMA), 24).collect(), 24)
    rows += [(i, f"short {i}") for i in range(100, 1100)]
    check(rows, D.place(spark.createDataFrame(rows, SCHEMA), 24).collect(), 24)


def test_no_range_is_overfull(spark):
    """A third of all rows are empty texts, another third one long text: neither fills a range."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "a text of a hundred bytes, " * 4).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    rows = D.sized(df).withColumn("key", F.struct("h", F.col("doc_id").alias("id"), F.col("doc_id").alias("row"))).drop("h")
    ranged, sums = D.ranges(rows, 24)
    share = sum(r["bytes"] for r in sums) / 192
    assert sum(r["rows"] for r in sums) == 30_000 == ranged.count()
    assert all(r["bytes"] - r["most"] <= 2 * share and r["rows"] <= 2000 for r in sums)
