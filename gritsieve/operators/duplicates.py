"""Exact and near duplicates of vectors in an ordered table (key, ts/seq, id, features)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gritsieve.functions import stats as S
from gritsieve.functions.cut import checkpointed
from gritsieve.functions.ranks import MOST_BROADCAST

DIGITS = 4
LAST = 5000
#: Numbers of a tile's samples, 32 MB.
TILE = 1 << 22


def rounded(features: str = "features") -> Column:
    """The vector at 4 decimals, half to even, without negative zeros."""
    return F.transform(features, lambda x: S.half_even(x, DIGITS))


def sign_bits(vector: Column) -> Column:
    """One character for each element: 1 where it lies above the vector's own mean.

    The vector and its mean pass through lists of one, so that each is worked out once and not for every element.
    """
    once = lambda x, f: F.transform(F.array(x), f)[0]
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))  # noqa: E731  an empty vector has none
    return once(vector, lambda v: once(mean(v), lambda m: F.array_join(F.transform(v, lambda x: F.when(x - m > 0, "1").otherwise("0")), "")))


def _after_the_first(df: DataFrame, key: Column, order: list[str], flag: str) -> DataFrame:
    """`df` with a flag on the rows that come after the first one of their key.

    Keys that several rows have are aggregated before the shuffle and written, a row for each, then joined back: broadcast
    where their number allows, else by shuffles of which adaptive execution splits those of hot keys.
    """
    keyed = df.withColumn("_k", key)
    first = keyed.filter("_k is not null").groupBy("_k").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n"))
    first = checkpointed(first.filter("_n > 1").drop("_n"))
    small = F.broadcast(first) if first.count() <= MOST_BROADCAST else first
    return keyed.join(small, "_k", "left").withColumn(flag, F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_k", "_first")


def exact_duplicates(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with exact_dup: an earlier row has the same rounded vector; rows without a vector are no duplicates."""
    return _after_the_first(df, F.sha2(F.to_json(rounded()), 256), order, "exact_dup")


def pattern_duplicates(df: DataFrame, order: list[str], min_dims: int = 0) -> DataFrame:
    """`df` with bits_dup: an earlier row has the same bit pattern (never, below min_dims elements, nor without a vector)."""
    found = _after_the_first(df, sign_bits(rounded()), order, "bits_dup")
    return found.withColumn("bits_dup", F.col("bits_dup") & (F.size("features") >= min_dims)) if min_dims else found


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal width over their norms; zeros where the norm is below 1e-10."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(axis=1))
    return np.where((n < 1e-10)[:, None], 0.0, x / np.where(n < 1e-10, 1.0, n)[:, None])


def max_similarity(samples: DataFrame, references: DataFrame, most: int = 1 << 25) -> DataFrame:
    """(id, max_sim): the largest cosine to any reference, 0 at least.

    References of at most `most` numbers are broadcast as one matrix, after their size is checked, and samples are never
    shuffled. More never pass through the driver: samples are dealt into tiles, and each tile's task holds its samples'
    matrix and multiplies it by the references as they come, a block after another.
    """
    size = references.agg(F.sum(F.size("features"))).first()[0] or 0
    if size <= most:
        return _against(samples.select("id", "features"), references.select("features").toArrow().column("features").combine_chunks())
    return _tiled(samples, references, max(1, min(most, TILE)))


def _tiled(samples: DataFrame, references: DataFrame, most: int) -> DataFrame:
    """(id, max_sim) of samples against references of any number, in blocks of about `most` numbers."""
    spark, kind = samples.sparkSession, samples.schema["id"].dataType.simpleString()
    at = F.monotonically_increasing_id()
    rows = checkpointed(samples.select("id", F.col("features").cast("array<double>").alias("features"), at.alias("_at")))
    numbers = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    tiles = max(2 * spark.sparkContext.defaultParallelism, -(-numbers // TILE))
    # each partition's rows are dealt round the tiles, so tiles differ by a row for each partition at most
    tile = F.pmod(F.col("_at").bitwiseAND((1 << 33) - 1) + F.shiftright("_at", 33), F.lit(tiles)).cast("int")
    mine = rows.select(tile.alias("_tile"), F.lit(True).alias("_own"), "id", "features")
    theirs = references.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"), F.lit(False).alias("_own"), F.lit(None).cast(kind).alias("id"), F.col("features").cast("array<double>").alias("features"))
    dealt = mine.unionByName(theirs).repartitionById(tiles, "_tile").sortWithinPartitions(F.desc("_own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, best = [], None, None
        for batch in batches:
            n = pc.sum(batch.column(1)).as_py() or 0  # a tile's own rows come first
            if n:
                own.append(batch.slice(0, n))
            for a in range(n, batch.num_rows, step := max(1, most // max(1, pc.max(pc.list_value_length(batch.column(3))).as_py() or 1))):
                if own and x is None:
                    x = np.concatenate([_units(b.column(3)) for b in own])
                    best = np.zeros(len(x))
                block = _units(batch.column(3).slice(a, step))
                for k in range(0, len(x) if x is not None else 0, 256):
                    best[k : k + 256] = np.maximum(best[k : k + 256], (x[k : k + 256] @ block.T).max(axis=1))
        at = 0
        for b in own:
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(best[at : at + b.num_rows] if best is not None else np.zeros(b.num_rows))], names=["id", "max_sim"])
            at += b.num_rows

    return dealt.mapInArrow(run, f"id {kind}, max_sim double")


def _against(samples: DataFrame, references: pa.Array) -> DataFrame:
    """(id, max_sim) of samples (id, features) against one matrix."""
    shared = samples.sparkSession.sparkContext.broadcast(_units(references) if len(references) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.zeros(batch.num_rows)
            for a in range(0, batch.num_rows if shared.value is not None else 0, 256):
                own = _units(batch.column(1).slice(a, 256))
                best[a : a + 256] = np.maximum((own @ shared.value.T).max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], names=["id", "max_sim"])

    return samples.mapInArrow(run, f"id {samples.schema['id'].dataType.simpleString()}, max_sim double")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """`df` with _n, the place of each row in the order: sorted ranges, and a count for each."""
    ranged = checkpointed(df.orderBy(order, "id").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_part").count().collect()):  # a row for each partition
        starts.append((r["_part"], before))
        before += r["count"]
    table = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    return ranged.join(F.broadcast(table), "_part").withColumn("_n", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at")


def near_duplicates(df: DataFrame, seq: str = "seq", threshold: float = 0.95, last: int = LAST) -> DataFrame:
    """(id, max_sim, near_dup) against the `last` rows before each, every row being added.

    Rows are numbered in order and dealt into blocks of `last`; a block meets itself and the one before as two
    matrices, so a task never holds more than two blocks.
    """
    kind = df.schema["id"].dataType.simpleString()
    rows = numbered(df.select("id", seq, "features"), seq).select("id", "features", "_n", F.floor(F.col("_n") / last).alias("_own"))
    dealt = rows.withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1))).repartition("_b").sortWithinPartitions("_b", "_n")

    def compare(block: pa.Table) -> pa.RecordBatch:
        n, own = block.column("_n").to_numpy(), block.column("_own").to_numpy() == block.column("_b").to_numpy()
        mine = np.flatnonzero(own)
        x = _units(block.column("features").combine_chunks()) if len(mine) else None
        best = np.zeros(len(mine))
        for a in range(0, len(mine), 256):
            at = mine[a : a + 256]
            seen = (n[None, :] < n[at][:, None]) & (n[None, :] >= n[at][:, None] - last)
            best[a : a + 256] = np.where(seen, x[at] @ x.T, 0.0).max(axis=1)
        return pa.RecordBatch.from_arrays([block.column("id").combine_chunks().take(pa.array(mine)), pa.array(np.maximum(best, 0.0))], names=["id", "max_sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = table.column("_b").to_numpy()
            for part in np.split(np.arange(len(block)), np.flatnonzero(block[1:] != block[:-1]) + 1):
                if not len(part):
                    continue
                piece = table.slice(int(part[0]), len(part))
                if held and held[-1].column("_b")[0] != piece.column("_b")[0]:
                    yield compare(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield compare(pa.concat_tables(held))

    best = dealt.mapInArrow(run, f"id {kind}, max_sim double")
    return best.withColumn("near_dup", F.col("max_sim") >= threshold)


def duplicates(df: DataFrame, seq: str = "seq", threshold: float = 0.95, last: int = LAST) -> DataFrame:
    """(id, exact_dup, bits_dup, near_dup, duplicate): a row is a near duplicate only where the cheap checks say nothing."""
    order = [seq]
    flagged = pattern_duplicates(exact_duplicates(df, order), order)
    cheap = F.col("exact_dup") | F.col("bits_dup")
    near = near_duplicates(df, seq, threshold, last)
    out = flagged.select("id", "exact_dup", "bits_dup", cheap.alias("_c")).join(near, "id")
    return out.select("id", "exact_dup", "bits_dup", (F.col("near_dup") & ~F.col("_c")).alias("near_dup"), (F.col("_c") | F.col("near_dup")).alias("duplicate"))


def add_samples(store: DataFrame, samples: DataFrame, seq: str = "seq", last: int = LAST) -> DataFrame:
    """The reference store after appending samples: the newest `last` rows."""
    both = store.unionByName(samples)
    return both.orderBy(F.desc(seq)).limit(last)


def fingerprint_stats(flags: DataFrame) -> DataFrame:
    """One row of counts over duplicate flags."""
    return flags.agg(F.count("*").alias("seen"), F.count_if("exact_dup").alias("exact"), F.count_if("bits_dup").alias("patterns"), F.count_if("near_dup").alias("near"), F.count_if("duplicate").alias("duplicates"))
