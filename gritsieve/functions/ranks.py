"""Exact percentiles and ranks within groups of any size: no task holds or sorts a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritsieve.functions.cut import checkpointed

#: Rows of a small table that are broadcast; larger ones are joined by shuffling.
MOST_BROADCAST = 1 << 20


def beside(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """`rows` joined with a checkpointed table of groups, broadcast where its size, which is counted, allows."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, by)


def percentiles(values: DataFrame, by: list[str], ps: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(by..., n, q array<double>): exact linear percentiles of (by..., x) in each group; null values, and groups without a name, are left out.

    A sketch gives an interval around each wanted rank; one pass counts what lies below it and each value inside it, so
    equal values are added up where they are. Where an interval has missed its rank, which the counts show, a wider
    one is tried, up to the whole group.
    """
    values = values.filter("x is not null")
    found, slack = None, 2.0 / accuracy
    wanted = None
    while True:
        near = [p for q in ps for p in (max(0.0, q - slack), min(1.0, q + slack))]
        todo = values if found is None else beside(values, wanted, by)
        sketch = todo.groupBy(*by).agg(F.percentile_approx("x", near, accuracy).alias("b"), F.count("x").alias("n"))
        each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("b")[2 * k].alias("low"), F.col("b")[2 * k + 1].alias("high")) for k, p in enumerate(ps)])
        brackets = checkpointed(sketch.select(*by, "n", F.posexplode(each).alias("k", "w")).select(*by, "n", "k", "w.*"))
        got = checkpointed(_select(beside(todo, brackets, by), by))
        done = got.groupBy(*by).agg(F.min("ok").alias("ok"), F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("q"))
        good = done.filter("ok").drop("ok")
        found = good if found is None else found.unionByName(good)
        missed = got.filter("not ok")
        if missed.isEmpty():
            return found
        wanted = checkpointed(missed.select(*by).distinct())
        slack *= 16


def _select(joined: DataFrame, by: list[str]) -> DataFrame:
    """(by..., k, n, v, ok): the percentile of each interval, and whether its rank lies inside."""
    keys = [*by, "k", "p", "n"]
    inside = F.when(F.col("x") >= F.col("low"), F.col("x"))  # null: below
    counts = joined.filter(F.col("x") <= F.col("high")).groupBy(*keys, inside.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))  # distinct values of an interval
    target = F.col("p") * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > rank), F.col("v")))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    out = counts.withColumn("upto", upto).groupBy(*keys).agg(at(F.floor(target)).alias("a"), at(F.ceil(target)).alias("b"), below.alias("below"), F.max("upto").alias("all"))
    ok = (F.col("below") <= F.floor(target)) & (F.col("all") > F.ceil(target))
    return out.select(*by, "k", "n", (F.col("a") + (F.col("b") - F.col("a")) * (target - F.floor(target))).alias("v"), ok.alias("ok"))


def ranked(rows: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their place in their group, from 1: Spark sorts all rows, and sums over the parts of each group number them."""
    placed = checkpointed(rows.orderBy(by, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    parts = checkpointed(parts.withColumn("_before", before))  # a row for each partition of the sort and each group in it
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of"))
    out = placed.join(F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts, same)
    return out.select(*rows.columns, place.alias(name))
