"""A forest that is grown anew while the stream runs.

Every trigger scores by the newest forest that an earlier trigger wrote, numbered by the
trigger after it; its clean rows then enter a window of the newest, and when enough have come since the last
forest, the next one is grown from the window. All tables are numbered by trigger and written
anew when a trigger is repeated, and what a trigger reads has lower numbers: a stream that is stopped
anywhere goes on with the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gritsieve.functions.cut import checkpointed
from gritsieve.operators import forest as I
from gritsieve.operators.forest import Forest
from gritsieve.streaming.scoring import REFIT_EVERY, REFIT_LEAST, WINDOW

_CLEAN = "key string, ts timestamp, id bigint, features array<double>"


def _numbers(folder: str) -> list[int]:
    """Numbers of the whole tables in a folder that workers see; a table is whole once its marker file is there."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    return sorted(int(m[1]) for f in found if (m := re.search(r"/n=(\d+)/_SUCCESS$", f.path)))


@lru_cache(maxsize=4)
def _read(folder: str, number: int) -> Forest:
    """Forest `number`, once a worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "/", f"{folder}/n={number}"))
    rows = pq.read_table(place, filesystem=store, partitioning=None).to_pylist()
    one = Forest.of([tuple(r[c] for c in ("tree", "node", "feature", "split", "low", "high", "depth")) for r in rows], rows[0]["sample"], rows[0]["contamination"])
    one.offset = rows[0]["offset"]
    return one


@lru_cache(maxsize=4)
def _known(folder: str, batch: int) -> int | None:
    return max((n for n in _numbers(folder) if n <= batch), default=None)


def newest_forest(folder: str) -> Forest | None:
    """In a task of a stream: the newest forest of the triggers before this one."""
    context = TaskContext.get()
    batch = context.getLocalProperty("streaming.sql.batchId") if context is not None else None
    number = _known(folder, int(batch)) if batch is not None else None
    return None if number is None else _read(folder, number)


def refit_sink(folder: str, write: Callable[[DataFrame, int], None] | None = None, every: int = REFIT_EVERY, least: int = REFIT_LEAST, window: int = WINDOW, contamination: float = 0.05, seed: int = 42) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for scored rows with their samples (score_stream with forests=f"{folder}/forests").

    It passes the rows on to `write`, keeps the newest `window` clean rows, and grows a forest from them once `every`
    clean rows have come since the last one. A trigger's window and forest are at most `window` rows and 51,100 nodes.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        if write is not None:
            write(rows, batch_id)
        clean = rows.filter("not is_poisoned and error is null").select("key", "ts", "id", "features")
        earlier = max((n for n in _numbers(f"{folder}/window") if n <= batch_id), default=None)
        before = spark.read.parquet(f"{folder}/window/n={earlier}") if earlier is not None else spark.createDataFrame([], f"{_CLEAN}, since bigint")
        since = (before.agg(F.max("since")).first()[0] or 0) + clean.count()
        newest = checkpointed(before.drop("since").unionByName(clean).orderBy(F.desc("ts"), F.desc("id")).limit(window))
        grown = since >= every and newest.limit(least).count() >= least
        if grown:
            one = I.fit(newest.select("id", "features"), contamination, seed)
            nodes = spark.createDataFrame(one.rows(), I.NODES).coalesce(1)  # at most 511 nodes a tree
            nodes.withColumns({"sample": F.lit(one.sample), "contamination": F.lit(contamination), "offset": F.lit(one.offset)}).write.mode("overwrite").parquet(f"{folder}/forests/n={batch_id + 1}")
        newest.withColumn("since", F.lit(0 if grown else since).cast("long")).write.mode("overwrite").parquet(f"{folder}/window/n={batch_id + 1}")
        rows.unpersist()

    return run
