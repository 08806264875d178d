"""Keyed state with timers, and a join of two streams.

`watch_sites` keeps one small state row per site and sets an event-time timer: a site that falls silent turns stale by
itself, when the watermark passes its limit, without a new reading; later its state is dropped. `with_weather` joins readings
with the daily rows of the days before them, both as streams; a reading that finds none is emitted when the watermark says none
can come. Both recover from their checkpoint."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

DAY_MS = 86_400_000
#: The state store that keyed timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LATEST = StructType([StructField("ts_us", LongType()), StructField("event_id", LongType()), StructField("value", DoubleType()), StructField("n", LongType()), StructField("stale", LongType())])


@contextmanager
def keyed_store(spark: SparkSession):
    """Queries started inside keep their state in the store that keyed timers need."""
    before = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class SiteWatch(StatefulProcessor):
    """Latest reading of a site (by time, then id), its count of readings, and a timer for its silence."""

    def __init__(self, limit_ms: int, expire_ms: int):
        self.limit_ms, self.expire_ms = limit_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", LATEST)

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _row(self, key, s) -> Row:
        return Row(site=key[0], latest_value=s[2], latest_us=s[0], n=s[3], stale=s[4])

    def handleInputRows(self, key, rows, timerValues):
        s = self.latest.get() if self.latest.exists() else None
        best, n = ((s[0], s[1], s[2]), s[3]) if s else (None, 0)
        for r in rows:
            n += 1
            if best is None or (r["ts_us"], r["event_id"]) > best[:2]:
                best = (r["ts_us"], r["event_id"], r["value"])
        # Already silent for too long when it arrives: the timer would fire at once.
        stale = int(timerValues.getCurrentWatermarkInMs() >= best[0] // 1000 + self.limit_ms)
        new = (*best, n, stale)
        self.latest.update(new)
        self._timer(best[0] // 1000 + (self.expire_ms if stale else self.limit_ms))
        yield self._row(key, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = self.latest.get()
        if s[4]:
            self.latest.clear()                      # silent beyond its expiry: nothing is kept or said
            return
        new = (s[0], s[1], s[2], s[3], 1)
        self.latest.update(new)
        self.handle.registerTimer(s[0] // 1000 + self.expire_ms)
        yield self._row(key, new)

    def close(self) -> None:
        pass


def watch_sites(stream: DataFrame, limit_days: float, expire_days: float = 3650.0, delay: str = "0 seconds", site: str = "user_id", event_time: str = "ts", value: str = "value") -> DataFrame:
    """(site, latest_value, latest_ts, n, stale), one row whenever a site has new readings or turns stale (update mode). Rows without a
    site or time are left out; rows later than the watermark are dropped by the engine."""
    d = stream.where(F.col(site).isNotNull() & F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    d = d.select(F.col(site).alias("site"), F.col(event_time), F.unix_micros(event_time).alias("ts_us"), F.col("event_id").cast("bigint").alias("event_id"), F.col(value).cast("double").alias("value"))
    kind = StructType.fromDDL(f"site {d.schema['site'].dataType.simpleString()}, latest_value double, latest_us bigint, n bigint, stale bigint")
    out = d.groupBy("site").transformWithState(SiteWatch(int(limit_days * DAY_MS), int(expire_days * DAY_MS)), kind, "Update", "EventTime")
    return out.select(F.col("site").alias(site), "latest_value", F.timestamp_micros("latest_us").alias("latest_ts"), "n", "stale")


def with_weather(readings: DataFrame, weather: DataFrame, days: int, keep: list[str], cols: list[str], station: str = "station", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Every reading with each weather row of its station from `days` days before up to the day before; a row of nulls where there is none
    (append mode). Both streams carry a watermark, so state holds `days` days and the delay; rows without a time are left out.
    The last readings are emitted when later rows, or heartbeats, move the watermark on.

    State is kept by station and calendar day: a weather row is there once for each day whose readings it may meet (`days` + 1 of them),
    a reading once, under its own day, so a row is compared with the rows of a few days and not with all that a station has in state."""
    left = readings.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(*[F.col(c).alias(f"_l_{c}") for c in dict.fromkeys([*keep, station, ts])])
    right = weather.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(*[F.col(c).alias(f"_r_{c}") for c in dict.fromkeys([*cols, station, ts])])
    left = left.withColumn("_l__day", F.to_date(f"_l_{ts}"))
    right = right.withColumn("_r__day", F.explode(F.expr(f"sequence(to_date(`_r_{ts}`), date_add(to_date(`_r_{ts}`), {days}))")))
    near = F.expr(f"`_r_{ts}` >= `_l_{ts}` - interval {days} days and `_r_{ts}` < `_l_{ts}`")
    both = left.join(right, (F.col(f"_l_{station}") == F.col(f"_r_{station}")) & (F.col("_l__day") == F.col("_r__day")) & near, "left_outer")
    return both.select(*[F.col(f"_l_{c}").alias(c) for c in keep], F.col(f"_r_{ts}").alias("weather_ts"), *[F.col(f"_r_{c}").alias(c) for c in cols])
