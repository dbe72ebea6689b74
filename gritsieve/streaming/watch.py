"""Counters of running streams: metrics that Spark observes on the way, a row for each trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Metrics of scored rows and of routed rows, by the name under which they are observed.
SCORED, ROUTED = "scored_rows", "routed_rows"
LATE = "rows_late"


def observe_scored(scored: DataFrame) -> DataFrame:
    """Scored rows as they are, counted on their way: seen, poisoned, refused."""
    usable = F.col("error").isNull()
    return scored.observe(SCORED, F.count_if(usable).alias("seen"), F.count_if(usable & F.col("is_poisoned")).alias("poisoned"), F.count_if(~usable).alias("refused"))


def observe_routed(routed: DataFrame) -> DataFrame:
    """Routed rows as they are, counted on their way: consumed, processed, quarantined, dead_lettered."""
    of = lambda r: F.count_if(F.col("route") == r)
    return routed.observe(ROUTED, F.count(F.lit(1)).alias("consumed"), (F.count(F.lit(1)) - of("dead_letter")).alias("processed"), of("quarantine").alias("quarantined"), of("dead_letter").alias("dead_lettered"))


def _row(progress, name: str) -> dict | None:
    """A trigger's metrics with its number, the rows it read, and those that its watermark dropped (counted after partial sums)."""
    found = progress.observedMetrics.get(name)
    if found is None:
        return None
    late = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
    return {"batch": progress.batchId, "rows_read": progress.numInputRows, LATE: late, **found.asDict()}


class TriggerLog(StreamingQueryListener):
    """Writes the metrics `name` of every trigger as a row under `folder`, one folder a trigger, so that a repeated one replaces itself."""

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, name, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = _row(event.progress, self.name)
        if row is not None:
            schema = ", ".join(f"{c} bigint" for c in row)
            self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/trigger={row['batch']}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def recent_triggers(query: StreamingQuery, name: str) -> list[dict]:
    """The metrics `name` of the triggers that a query still remembers."""
    return [row for p in query.recentProgress if (row := _row(p, name)) is not None]
