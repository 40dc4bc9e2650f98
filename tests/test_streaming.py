"""Streams against batches over the same rows: rows before and behind the watermark, and a restart from the checkpoint."""

import pytest

from textloom.streaming.usage import latest, running, sessions, sliding, tumbling

SF = "/root/testdata/sf0.001"
EVENT = "user_id long, event_type string, ts timestamp, value double"
FIRST = [(1, "a", "2024-01-01 10:00:00", 1.0), (1, "a", "2024-01-01 10:20:00", 2.0), (2, "b", "2024-01-01 12:00:00", 4.0)]
SECOND = [(1, "a", "2024-01-01 10:05:00", 8.0), (1, "a", "2024-01-01 11:55:00", 16.0), (2, "b", "2024-01-01 12:30:00", 32.0), (2, "b", None, 64.0), (3, "c", "2024-01-01 15:00:00", None)]
THIRD = [(1, "a", "2024-01-01 09:00:00", 128.0), (1, "a", "2024-01-01 11:50:00", 256.0)]


class Feed:
    """A folder of batches, and a stream over it that stops after each and starts again from its checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def add(self, rows):
        self.spark.createDataFrame([(u, t, ts, v) for u, t, ts, v in rows], "user_id long, event_type string, ts string, value double").selectExpr("user_id", "event_type", "cast(ts as timestamp) ts", "value").coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, view, mode, into):
        stream = self.spark.readStream.schema(EVENT).parquet(f"{self.path}/in")
        query = view(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/{into}-c")
        query = query.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{self.path}/{into}/batch={k}")).trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self, into):
        return self.spark.read.parquet(f"{self.path}/{into}").collect()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_stream_counts_every_event(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    run.processAllAvailable()
    run.stop()
    got = spark.table("hours").selectExpr("sum(n) as n", "sum(total) as total").first()
    want = events.selectExpr("count(*) as n", "sum(value) as total").first()
    assert got["n"] == want["n"] and abs(got["total"] - want["total"]) < 1e-6


def test_windows_close_behind_the_watermark_and_leave_late_rows_out(feed):
    for rows in (FIRST, SECOND, THIRD):
        feed.add(rows)
        feed.run(tumbling, "append", "hours")
        feed.run(sessions, "append", "sessions")
        feed.run(sliding, "append", "sliding")
    hours = {(r["event_type"], r["hour"].hour): (r["n"], r["total"]) for r in feed.rows("hours")}
    # 10:05 of the second batch is behind 11:50, the watermark that the first batch left; so are both of the third
    assert hours == {("a", 10): (2, 3.0), ("a", 11): (1, 16.0), ("b", 12): (2, 36.0)}
    got = {(r["user_id"], r["start"].strftime("%H:%M"), r["stop"].strftime("%H:%M")): r["n"] for r in feed.rows("sessions")}
    assert got == {(1, "10:00", "10:50"): 2, (1, "11:55", "12:25"): 1, (2, "12:00", "13:00"): 2}
    slid = {(r["event_type"], r["start"].strftime("%H:%M")): r["n"] for r in feed.rows("sliding")}
    assert slid[("a", "09:15")] == 1 and slid[("a", "09:30")] == 2 and slid[("a", "10:00")] == 2 and slid[("a", "10:15")] == 1 and slid[("b", "11:45")] == 2


def test_state_by_key_survives_restarts_and_counts_late_rows(feed):
    for rows in (FIRST, SECOND, THIRD):
        feed.add(rows)
        feed.run(running, "update", "state")
    got = {(r["batch"], r["user_id"]): (r["n"], r["total"], r["n_late"]) for r in feed.rows("state")}
    assert got == {
        (0, 1): (2, 3.0, 0), (0, 2): (1, 4.0, 0),
        (1, 1): (3, 19.0, 1), (1, 2): (2, 36.0, 1), (1, 3): (1, 0.0, 0),  # 10:05 is 15 minutes late, a null time is late
        (2, 1): (4, 275.0, 2),  # 11:50 is within ten minutes of 11:55
    }


def test_latest_rows_over_restarts(feed):
    for rows in (FIRST, SECOND):
        feed.add(rows)
        stream = feed.spark.readStream.schema(EVENT).parquet(f"{feed.path}/in")
        latest(stream, f"{feed.path}/last", f"{feed.path}/last-c", n=3).awaitTermination()
    last = feed.spark.read.parquet(f"{feed.path}/last/batch=1").collect()
    assert sorted(str(r["ts"])[11:16] for r in last) == ["12:00", "12:30", "15:00"]
