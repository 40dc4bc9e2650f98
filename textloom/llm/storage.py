"""Shared storage: where the operators cut lineage and leave their files.

Everything goes below the session's checkpoint folder (``spark.checkpoint.dir`` or
``setCheckpointDir``), which every executor and the driver see.  A local session without one
(tests) gets a folder in the system's temporary directory; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.batches import BATCH, small_batches  # noqa: F401  for the operators


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder as a URI, without a trailing slash."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():  # qualified by Hadoop, from the setting or a call of setCheckpointDir
        at = found.get().rstrip("/")
        return at if not at.startswith("file:/") or at.startswith("file://") else "file://" + at[len("file:") :]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return shared_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; cuts the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    """``written``, with the writer's ``options``, and a function that deletes the table once all that reads it is checkpointed or written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)

    def drop() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        swept(spark)

    return spark.read.schema(df.schema).parquet(path), drop


def swept(spark: SparkSession) -> None:
    """Frees the disk of finished jobs: Spark deletes a shuffle's files when the driver's handle of it is collected.

    Iterative operators leave many shuffles behind a checkpoint; a driver with little to do may
    not collect them for half an hour.
    """
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint, for results of a few bytes a row."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
