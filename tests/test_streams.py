"""Streams over several micro-batches: timers, restarts, late rows, a join of two streams."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeline.session import scratch_path
from gaugeline.streaming import jobs, stateful

EVENTS = "event_id bigint, ts timestamp, user_id bigint, value double"


def arrive(spark, path, rows):
    """One file, which the next micro-batch reads."""
    d = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, value double")
    d.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "value").coalesce(1).write.mode("append").parquet(path)


def watch(spark, src, out, ck):
    with stateful.keyed_store(spark):
        q = jobs.state_sink(stateful.watch_sites(jobs.file_stream(spark, src, EVENTS), 2.0, expire_days=10.0), out, ck)
        q.awaitTermination()
    return spark.read.parquet(out)


BATCHES = [[(1, "2024-01-01 00:00:00.000001", 1, 1.0), (2, "2024-01-01", 2, 2.0), (3, None, 2, 9.0), (4, "2024-01-01", None, 9.0)], [(5, "2024-01-05", 2, 3.0)], [(6, "2024-01-05 01:00:00", 2, 4.0), (7, "2024-01-09", 3, 3.0)],
           [(8, "2024-01-09 12:00:00", 1, 3.0)], [(9, "2024-02-20", 3, 5.0)], [(10, "2024-02-20", 3, 6.0)]]


def test_a_silent_site_turns_stale_by_itself(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    for b in BATCHES[:2]:
        arrive(spark, src, b)
    rows = watch(spark, src, out, ck).orderBy("batch").collect()
    assert [(r.user_id, r.latest_value, r.stale) for r in rows if r.user_id == 1] == [(1, 1.0, 0), (1, 1.0, 1)]      # no reading of site 1 in between
    assert rows[0]["latest_ts"].microsecond in (0, 1) and {r.user_id for r in rows} == {1, 2}


def test_restarts_give_the_same_table(spark):
    tables = []
    for stops in ([6], [1, 3, 4, 6], [2, 6]):
        src, out, ck, done = *(scratch_path(spark, n) for n in ("src", "out", "ck")), 0
        for stop in stops:
            for b in BATCHES[done:stop]:
                arrive(spark, src, b)
            done = stop
            watch(spark, src, out, ck)
        tables.append(Counter(tuple(r) for r in jobs.merged(spark, out, ["user_id"]).select("user_id", "latest_value", "latest_ts", "n", "stale").collect()))
    assert tables[0] == tables[1] == tables[2]
    assert {k[0]: (k[1], k[3], k[4]) for k in tables[0]} == {1: (3.0, 2, 1), 2: (4.0, 3, 1), 3: (6.0, 3, 0)}


def test_expired_state_starts_anew(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    for b in (*BATCHES[:2], [(20, "2024-03-01", 7, 1.0)], [(21, "2024-03-02", 1, 8.0)]):
        arrive(spark, src, b)
        watch(spark, src, out, ck)
    last = {r.user_id: r for r in jobs.merged(spark, out, ["user_id"]).collect()}
    assert last[1].n == 1 and last[1].latest_value == 8.0 and last[1].stale == 0


def test_rows_later_than_the_watermark_are_dropped(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    for b in ([(1, "2024-01-10", 1, 1.0)], [(2, "2024-01-11", 1, 2.0), (3, "2024-01-09", 1, 4.0)], [(4, "2024-01-02", 1, 8.0), (5, "2024-01-11 05:00:00", 2, 16.0)]):
        arrive(spark, src, b)
    jobs.state_sink(jobs.daily_rollup(jobs.file_stream(spark, src, EVENTS)), out, ck).awaitTermination()
    got = {str(r.day): (r.n, r.total) for r in jobs.merged(spark, out, ["day"]).collect()}
    assert got == {"2024-01-10": (1, 1.0), "2024-01-11": (2, 18.0), "2024-01-09": (1, 4.0)}      # 2 January came too late


@pytest.mark.parametrize("splits", [1, 3])
def test_stream_join_equals_the_batch_join(spark, splits):
    left = [(i, i % 3, f"2024-01-{1 + i:02d}") for i in range(20)] + [(50, None, "2024-01-03"), (51, 1, None)]
    right = [(s, f"2024-01-{d:02d}", float(s * 100 + d)) for s in (0, 1) for d in range(1, 22) if d % 4]
    a, b, out, ck = (scratch_path(spark, n) for n in ("a", "b", "out", "ck"))
    lf = spark.createDataFrame(left, "row_id bigint, station bigint, t string").select("row_id", "station", F.col("t").cast("timestamp").alias("ts"))
    rf = spark.createDataFrame(right, "station bigint, t string, precip double").select("station", F.col("t").cast("timestamp").alias("ts"), "precip")
    beat = spark.createDataFrame([(None, None, "2025-01-01")], "x bigint, y bigint, t string").select("x", "y", F.col("t").cast("timestamp").alias("ts"))
    for frame, path, cols in ((lf, a, ["row_id", "station", "ts"]), (rf, b, ["station", "ts", "precip"])):
        for k in range(splits):
            day = F.coalesce(F.dayofmonth("ts"), F.lit(1))
            frame.where((day > k * 31 / splits) & (day <= (k + 1) * 31 / splits)).select(*cols).coalesce(1).write.mode("append").parquet(path)
    beat.select(F.col("x").alias("row_id"), F.col("y").alias("station"), "ts").coalesce(1).write.mode("append").parquet(a)
    beat.select(F.col("x").alias("station"), "ts", F.col("y").cast("double").alias("precip")).coalesce(1).write.mode("append").parquet(b)
    joined = stateful.with_weather(jobs.file_stream(spark, a, "row_id bigint, station bigint, ts timestamp"), jobs.file_stream(spark, b, "station bigint, ts timestamp, precip double"), 2, ["row_id"], ["precip"])
    jobs.append_sink(joined, out, ck).awaitTermination()
    got = Counter((r.row_id, r.precip) for r in spark.read.parquet(out).where("row_id is not null").collect())
    batch = lf.where("ts is not null").alias("l").join(rf.alias("r"), F.expr("l.station = r.station and r.ts >= l.ts - interval 2 days and r.ts < l.ts"), "left")
    assert got == Counter((r.row_id, r.precip) for r in batch.select("l.row_id", "precip").collect())


def test_stream_join_deals_the_rows_of_a_station_by_day(spark):
    """State of one station is spread by day, not compared and kept in one task; times within the day, rows that come twice, null stations
    and bounds to the microsecond give the rows of the batch join."""
    left = [(i, 1, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00") for i in range(200)] + [(7, 1, "2024-01-08 07:00:00"), (300, None, "2024-01-05 10:00:00"), (301, 2, "2024-01-05 10:00:00")]
    right = [(1, f"2024-01-{1 + i % 28:02d} {i * 5 % 24:02d}:00:00", float(i)) for i in range(90)] + [(1, "2024-01-06 07:00:00", 500.0), (1, "2024-01-06 06:59:59.999999", 501.0), (1, "2024-01-08 06:59:59.999999", 502.0), (None, "2024-01-04", 503.0)]
    a, b, out, ck = (scratch_path(spark, n) for n in ("a", "b", "out", "ck"))
    lf = spark.createDataFrame(left, "row_id bigint, station bigint, t string").select("row_id", "station", F.col("t").cast("timestamp").alias("ts"))
    rf = spark.createDataFrame(right, "station bigint, t string, precip double").select("station", F.col("t").cast("timestamp").alias("ts"), "precip")
    for frame, path in ((lf, a), (rf, b)):
        frame.coalesce(1).write.parquet(path)
        frame.limit(1).select(*[F.lit(None).cast(frame.schema[c].dataType).alias(c) if c != "ts" else F.lit("2025-01-01").cast("timestamp").alias("ts") for c in frame.columns]).write.mode("append").parquet(path)
    joined = stateful.with_weather(jobs.file_stream(spark, a, "row_id bigint, station bigint, ts timestamp"), jobs.file_stream(spark, b, "station bigint, ts timestamp, precip double"), 2, ["row_id"], ["precip"])
    jobs.append_sink(joined.withColumn("task", F.spark_partition_id()), out, ck).awaitTermination()
    rows = spark.read.parquet(out).where("row_id is not null").collect()
    batch = lf.alias("l").join(rf.alias("r"), F.expr("l.station = r.station and r.ts >= l.ts - interval 2 days and r.ts < l.ts"), "left")
    assert Counter((r.row_id, r.weather_ts, r.precip) for r in rows) == Counter((r.row_id, r.ts, r.precip) for r in batch.select("l.row_id", "r.ts", "r.precip").collect())
    assert len({r.task for r in rows if r.precip is not None}) > 1
