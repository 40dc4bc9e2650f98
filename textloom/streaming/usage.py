"""Usage as a stream: windows of three kinds, a state by key that counts what comes late, the last rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, hour, n, total of a stream of events (ts, event_type, value); rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", window).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sliding(events: DataFrame, window: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total of windows that overlap: each event counts in every window that holds it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", window, slide).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n, total of sessions: a user's events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def running(events: DataFrame, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """key, n, total, newest, n_late of a stream of events (key, ts, value) after each batch, for the keys that it held.

    A key's state is its sums and its newest time.  An event older than that by more than ``late``
    is counted in n_late and nowhere else; within a batch events are taken in order of time, so its
    division into tasks doesn't matter.  Null times are late, null values count as 0.
    """
    allowed = pd.Timedelta(late)

    def step(k: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, newest, n_late = state.get if state.exists else (0, 0.0, None, 0)
        high = pd.Timestamp(newest) if newest is not None else None
        rows = pd.concat(list(batches)).sort_values("ts")
        limit = high - allowed if high is not None else None
        kept = rows[rows.ts.notna() & ((rows.ts >= limit) if limit is not None else True)]
        n_late += len(rows) - len(kept)
        n, total = n + len(kept), total + float(kept.value.fillna(0).sum())
        if len(kept) and (high is None or kept.ts.max() > high):
            high = kept.ts.max()
        state.update((n, total, None if high is None else high.to_pydatetime(), n_late))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total], "newest": [high], "n_late": [n_late]})

    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    kind = rows.schema[key].dataType.simpleString()
    held = "n long, total double, newest timestamp, n_late long"
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {held}", held, "update", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, path: str, checkpoint: str, n: int = 200, order: str = "ts") -> StreamingQuery:
    """Keeps the last ``n`` rows of ``stream`` by ``order``: after batch b they are in ``path/batch=b``.

    A batch merges with what its predecessor left and overwrites its own folder, so one that is
    run again gives the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}") if number else batch.limit(0)
        rows = before.unionByName(batch).orderBy(F.col(order).desc(), *[F.col(c) for c in batch.columns if c != order]).limit(n)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
