"""Arrow batches of a bounded size for what runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch; executor and worker each hold one or two a task.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to ``BATCH`` bytes, a longer row alone; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH:
        spark.conf.set(key, BATCH)
