"""Cutting lineage with files that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a session on one machine gets a folder of that machine, any other one beside its tables,
    in the warehouse, which driver and executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            alone = context.master.split("[")[0] == "local"
            folder = tempfile.mkdtemp(prefix="gritsieve-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder: lost executors read it again.

    Spark removes the files when the result is no longer referred to, if the session
    sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, clean: bool = False) -> DataFrame:
    """`df` computed once and written to the shared folder as Parquet, of which later reads take the columns they need.

    With `clean` the shuffle files that led to it are gone when it is written, whenever garbage is collected.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does once the driver's garbage collector has found that nothing refers to them."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
