"""Structured Streaming jobs: validated ingestion, latest state per site, daily roll-up. Each is a plain function of a
streaming DataFrame, so a file source, Kafka or any other source works the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest_readings(stream: DataFrame, delay: str = "3 days", event_time="ts", key="event_id", required=("user_id", "value")) -> DataFrame:
    """Coerce, reject rows missing a required field, and drop repeated keys within the watermark."""
    d = stream.withColumn("value", F.col("value").try_cast("double"))
    for c in required:
        d = d.where(F.col(c).isNotNull())
    return d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def latest_state(stream: DataFrame, entity="user_id", event_time="ts", value="value") -> DataFrame:
    """Latest value, its time, and the number of readings per entity: built-in stateful aggregation (one small state row
    per entity), no custom state code."""
    return stream.groupBy(entity).agg(F.max_by(value, F.struct(event_time, "event_id")).alias("latest_value"),
                                      F.max(event_time).alias("latest_ts"), F.count(F.lit(1)).alias("n"))


def with_staleness(state: DataFrame, as_of, limit_days: float, event_time="latest_ts") -> DataFrame:
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(event_time)) / 86400.0
    return state.withColumn("age_days", age).withColumn("stale", (age > limit_days).cast("bigint"))


def daily_rollup(stream: DataFrame, delay: str = "2 days", event_time="ts", value="value") -> DataFrame:
    """Daily count, mean, min and max; rows later than the watermark are dropped by the engine."""
    return (stream.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("v_min"), F.max(value).alias("v_max"))
        .select(F.col("w.start").cast("date").alias("day"), "n", "total", "v_min", "v_max"))


def append_sink(stream: DataFrame, out: str, checkpoint: str):
    """Append each micro-batch to a Parquet table. The batch id is part of the path, so a replayed batch overwrites
    itself instead of being added twice."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_sink(stream: DataFrame, out: str, checkpoint: str):
    """Append-mode Parquet sink with exactly-once file commits."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_sink(stream: DataFrame, out: str, checkpoint: str):
    """Update-mode aggregates: a batch writes the keys it changed, under its own batch folder (a replayed batch overwrites
    itself). `merged` reads the newest version of every key, open windows included."""
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The state table behind `state_sink`: per key the row of its last batch, map-side combined."""
    d = spark.read.parquet(out)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def compact(spark: SparkSession, out: str, keys: list[str], into: str) -> None:
    """Rewrite the state table with one row per key, as batch 0 of a new folder."""
    merged(spark, out, keys).write.mode("overwrite").parquet(f"{into}/batch=00000000")
