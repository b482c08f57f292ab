"""Intermediate results in a folder that every executor can reach."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Spark's switch to remove the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, as the cluster names it.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackweave-"))
        current = context.getCheckpointDir()
    return current


def session_folder(spark: SparkSession) -> str:
    """The folder for the tables of this application. They are kept, as results read
    them; when the application is done, the folder can be deleted."""
    return os.path.join(shared_folder(spark), f"trackweave-{spark.sparkContext.applicationId}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a checkpoint, which keeps its partitioning."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a table, whose size the optimizer knows.

    The shuffle files of the computation go when the table is there, so that the disk a
    chain of stored tables needs is that of its largest step.
    """
    spark = df.sparkSession
    path = os.path.join(session_folder(spark), f"table-{uuid.uuid4().hex}")
    conf = spark.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more, so that the disk does not hold
    all tables of a long chain."""
    spark = df.sparkSession
    for folder in {os.path.dirname(file) for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
