"""Connected components of link tables, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node of (a, b) links.

    Each round lets every node take the least root among its neighbours', then
    follows the roots of roots, so distances halve; it ends when nothing changes.
    Minima are aggregated before they are shuffled.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    roots = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        moved = checkpointed(better.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("beyond", "next")).alias("next")))
        changed = moved.filter(F.col("next") < F.col("root")).limit(1).count()
        roots = moved.select("node", F.col("next").alias("root"))
        if not changed:
            return roots
