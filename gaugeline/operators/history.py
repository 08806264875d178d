"""History features of irregular readings, strictly from earlier dates.

Two grains: readings are first reduced to one row per (entity, day) with the day's mean and row count (map-side
combined, hashed on both columns, so a hot entity spreads over its days). Every window then runs on that table, where
an entity has at most one row per calendar day whatever the number of readings. Rows get their features back by an
equi-join on (entity, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import DENSITY_YEARS, LONG_GAP_DAYS, VERY_LONG_GAP_DAYS
from gaugeline.functions.scalars import DAYS_PER_YEAR
from gaugeline.operators import ordered


def day_table(readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """One row per (entity, day): mean of the day's values and number of rows."""
    return readings.groupBy(entity, ts).agg(F.avg(value).alias("day_mean"), F.count(F.lit(1)).alias("day_rows"))


def _by_day(entity, ts):
    return Window.partitionBy(entity).orderBy(ts)


def prior_levels(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    w = _by_day(entity, ts)
    return (days.withColumn("prev_value", F.lag("day_mean", 1).over(w))
            .withColumn("prev2_value", F.lag("day_mean", 2).over(w)))


def gap_since_previous(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    gap = F.datediff(ts, F.lag(ts, 1).over(_by_day(entity, ts))).cast("double")
    return days.withColumn("gap_days", gap).withColumn("gap_years", F.col("gap_days") / DAYS_PER_YEAR)


def rolling_last3(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    w = _by_day(entity, ts).rowsBetween(-3, -1)
    return (days.withColumn("roll3_mean", F.avg("day_mean").over(w))
            .withColumn("roll3_std", F.stddev_samp("day_mean").over(w)))


def level_change_trend(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    w = _by_day(entity, ts)
    change = F.lag("day_mean", 1).over(w) - F.lag("day_mean", 2).over(w)
    years = F.datediff(F.lag(ts, 1).over(w), F.lag(ts, 2).over(w)) / F.lit(DAYS_PER_YEAR)
    return (days.withColumn("prev_change", change)
            .withColumn("recent_trend", F.when(years > 0, F.col("prev_change") / years)))


def expanding_history(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    w = _by_day(entity, ts).rowsBetween(Window.unboundedPreceding, -1)
    return (days.withColumn("hist_mean", F.avg("day_mean").over(w))
            .withColumn("hist_std", F.stddev_samp("day_mean").over(w))
            .withColumn("hist_min", F.min("day_mean").over(w))
            .withColumn("hist_max", F.max("day_mean").over(w)))


def prior_row_count(days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    w = _by_day(entity, ts).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("prior_count", F.coalesce(F.sum("day_rows").over(w), F.lit(0)).cast("bigint"))


def observation_density(days: DataFrame, entity="entity_id", ts="ts", years: int = DENSITY_YEARS) -> DataFrame:
    """Rows in [day - years, day) per year. One frame may not mix calendar years and days, so the current day's own
    rows are subtracted from a frame that includes it."""
    incl = F.expr(f"sum(day_rows) over (partition by {entity} order by {ts} "
                  f"range between interval {years} year preceding and current row)")
    return days.withColumn("density", (incl - F.col("day_rows")) / F.lit(float(years)))


def gap_flags(df: DataFrame, gap="gap_days", long_days=LONG_GAP_DAYS, very_long_days=VERY_LONG_GAP_DAYS) -> DataFrame:
    return (df.withColumn("long_gap", F.when(F.col(gap) > long_days, 1).otherwise(0).cast("bigint"))
            .withColumn("very_long_gap", F.when(F.col(gap) > very_long_days, 1).otherwise(0).cast("bigint")))


def day_history(readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """All sixteen features at day grain: one shuffle for the reduction, one for every window."""
    d = day_table(readings, entity, ts, value)
    for step in (prior_levels, gap_since_previous, rolling_last3, level_change_trend, expanding_history,
                 prior_row_count, observation_density):
        d = step(d, entity, ts)
    return gap_flags(d)


def attach(readings: DataFrame, days: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    """Every reading gets its day's features; row count is preserved because (entity, day) is unique in `days`."""
    return readings.join(days.drop("day_mean", "day_rows"), [entity, ts], "left")


def history_features(readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    return attach(readings, day_history(readings, entity, ts, value), entity, ts)


def row_lag_features(readings: DataFrame, entity="entity_id", ts="ts", value="value", row_id="row_id",
                     long_days: float = 365.0) -> DataFrame:
    """Row-grain lags ordered by (day, row id) and kept inside the entity.

    The order (entity, day, row id) is cut into ranges of counted size; a segment is an entity's part of a range. Each segment
    is windowed alone; its row count and its last three readings are carried to the entity's following segments over a table with
    one row per segment: a row an entity, and one more for each cut inside it. So neither a hot entity nor a hot day is ever
    sorted in one task, wherever its ids lie."""
    seg = [entity, "_s"]
    rows = ordered.counted_segments(readings, [entity, ts, row_id], "_s")
    cell = F.struct(F.col(ts).alias("d"), F.col(value).alias("v"))
    w = Window.partitionBy(*seg).orderBy(ts, row_id)
    rows = (rows.withColumn("_rn", F.row_number().over(w))
            .withColumn("_near", F.filter(F.array(*[F.lag(cell, k).over(w) for k in (3, 2, 1)]), lambda x: x.isNotNull())))
    # the tail of a segment: its last row plus that row's up to two predecessors
    top = (rows.groupBy(*seg)
           .agg(F.count(F.lit(1)).alias("_sn"), F.max_by(F.struct("_near", cell.alias("_cur")), F.struct(ts, row_id)).alias("_x"))
           .withColumn("_tail", F.concat("_x._near", F.array("_x._cur"))).drop("_x"))
    o = Window.partitionBy(entity).orderBy("_s")
    empty = F.slice(F.col("_tail"), 1, 0)
    carry = top.select(
        *seg, F.coalesce(F.sum("_sn").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.concat(*[F.coalesce(F.lag("_tail", k).over(o), empty) for k in (3, 2, 1)]).alias("_carried"))
    j = ordered.null_safe_join(rows, carry, seg, "left").withColumn("_all", F.concat("_carried", "_near"))
    j = j.withColumn("_p", F.slice("_all", F.greatest(F.size("_all") - 2, F.lit(1)), 3))
    back = lambda k: F.try_element_at("_p", F.lit(-k))
    j = (j.withColumn("lag1", back(1)["v"]).withColumn("lag2", back(2)["v"])
         .withColumn("gap_days", F.datediff(F.col(ts), back(1)["d"]).cast("double"))
         .withColumn("lag_change", F.col("lag1") - F.col("lag2"))
         .withColumn("prior_rows", (F.col("_base") + F.col("_rn") - 1).cast("bigint"))
         .withColumn("roll3_rows_mean", F.when(F.size("_p") > 0, F.aggregate(
             "_p", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("_p")))
         .withColumn("long_gap", F.when(F.col("gap_days") > long_days, 1).otherwise(0).cast("bigint")))
    return j.drop("_s", "_rn", "_near", "_base", "_carried", "_all", "_p")


def delta_target(df: DataFrame, value="value", prev="prev_value") -> DataFrame:
    """Previous minus current (positive = the water table rises); null for a first reading."""
    return df.withColumn("delta", F.col(prev) - F.col(value))
