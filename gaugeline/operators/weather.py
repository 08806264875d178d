"""Regular covariate series and leakage-safe joins of it to readings.

The daily series has one row per station and calendar day. `station` names its key: windows run per station, so one
holds no more rows than there are days, and look-ups join on station and day, left to AQE as they grow with the number
of stations. Without a key the table is one station's, bounded by the calendar, and look-ups are broadcast. Windows are
computed once per day and looked up at `date - 1`; rainfall between two readings is a difference of two running totals,
not a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import PRECIP_WINDOWS, RAIN_THRESHOLD

DAILY_VARIABLES = ["precip", "temp", "rh", "wind", "solar"]


def _look_up(df: DataFrame, side: DataFrame, on: list[str], station: str | None) -> DataFrame:
    return df.join(side, [station, *on], "left") if station else df.join(F.broadcast(side), on, "left")


def _keys(station: str | None) -> list[str]:
    return [station] if station else []


def sentinel_to_null(df: DataFrame, cols=DAILY_VARIABLES, code: float = -990.0) -> DataFrame:
    """Missing codes (values at or below `code`) become null."""
    return df.withColumns({c: F.when(F.col(c) > code, F.col(c)) for c in cols})


def sentinel_counts(df: DataFrame, cols=DAILY_VARIABLES, code: float = -990.0) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) <= code).alias(f"{c}_codes") for c in cols])


def annual_weather(daily: DataFrame, station: str | None = None) -> DataFrame:
    """Yearly means and the yearly precipitation total, of each station; a year of nulls totals 0."""
    return daily.groupBy(*_keys(station), F.year("ts").alias("yr")).agg(
        F.avg("temp").alias("temp_mean"), F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip_total"),
        F.avg("rh").alias("rh_mean"), F.avg("wind").alias("wind_mean"), F.avg("solar").alias("solar_mean"))


def join_year(df: DataFrame, annual: DataFrame, station: str | None = None) -> DataFrame:
    """Same-year covariates, of the row's own station."""
    return _look_up(df, annual, ["yr"], station)


def join_prior_year(df: DataFrame, annual: DataFrame, cols=("temp_mean", "precip_total", "rh_mean", "wind_mean", "solar_mean"), station: str | None = None) -> DataFrame:
    """Strictly year Y-1, of the row's own station; absent years give nulls and `climate_available` 0."""
    lagged = annual.select(*_keys(station), (F.col("yr") + 1).alias("yr"), F.col("yr").alias("climate_year"), *cols)
    out = _look_up(df, lagged, ["yr"], station)
    ok = F.when(F.col("climate_year").isNull(), "missing").when(F.col("climate_year") < F.col("yr"), "prior_year").otherwise("violation")
    return (out.withColumn("climate_available", F.when(F.col("climate_year").isNotNull(), 1.0).otherwise(0.0))
            .withColumn("climate_check", ok))


def rolling_day_windows(daily: DataFrame, windows=PRECIP_WINDOWS, station: str | None = None) -> DataFrame:
    """N-day windows including the day itself."""
    part = f"partition by `{station}` " if station else ""

    def over(fn: str, days: int) -> F.Column:
        return F.expr(f"{fn} over ({part}order by ts range between interval {days - 1} day preceding and current row)")

    cols = {f"precip_{n}d": over("sum(precip)", n) for n in windows}
    cols |= {
        "rain_days_30d": over(f"sum(case when precip > {RAIN_THRESHOLD} then 1e0 else 0e0 end)", 30),
        "max_precip_30d": over("max(precip)", 30),
        "temp_mean_30d": over("avg(temp)", 30),
        "temp_max_30d": over("max(temp)", 30),
        "radiation_30d": over("sum(solar)", 30),
        "rh_mean_30d": over("avg(rh)", 30),
        "wind_mean_30d": over("avg(wind)", 30),
    }
    return daily.withColumns(cols)


def dry_spell_streak(daily: DataFrame, threshold: float = RAIN_THRESHOLD, station: str | None = None) -> DataFrame:
    """Consecutive days below the threshold ending today; a wet or missing day resets to 0."""
    w = Window.partitionBy(*_keys(station)).orderBy("ts")
    n = F.row_number().over(w)
    dry = F.coalesce(F.col("precip") < threshold, F.lit(False))
    last_wet = F.max(F.when(~dry, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (daily.withColumn("_n", n)
            .withColumn("dry_spell_days", (F.col("_n") - F.coalesce(last_wet, F.lit(0))).cast("double")).drop("_n"))


def cumulative_precip(daily: DataFrame, station: str | None = None) -> DataFrame:
    w = Window.partitionBy(*_keys(station)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("precip_cum", F.sum("precip").over(w))


WINDOW_COLUMNS = [f"precip_{n}d" for n in PRECIP_WINDOWS] + [
    "rain_days_30d", "max_precip_30d", "dry_spell_days", "temp_mean_30d", "temp_max_30d", "radiation_30d",
    "rh_mean_30d", "wind_mean_30d"]


def join_prior_day_windows(df: DataFrame, windows: DataFrame, cols=WINDOW_COLUMNS, station: str | None = None) -> DataFrame:
    """Windows as of the day before the reading (`cutoff` = date - 1), of the reading's own station."""
    side = windows.select(*_keys(station), F.date_add("ts", 1).alias("ts"), F.col("ts").alias("cutoff"), *cols)
    return _look_up(df, side, ["ts"], station).withColumn("cutoff", F.date_sub("ts", 1))


def every_day(daily: DataFrame, station: str | None = None) -> DataFrame:
    """The series with a row for every calendar day of each station's span; days without data hold nulls."""
    span = daily.groupBy(*_keys(station)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select(*_keys(station), F.explode(F.sequence("a", "b")).alias("ts")).join(daily, [*_keys(station), "ts"], "left")


def interval_sum_between_readings(df: DataFrame, daily: DataFrame, prev_ts="prev_ts", station: str | None = None) -> DataFrame:
    """Precipitation over [previous + 1, date - 1]: running total at date-1 minus running total at the previous
    reading. Consecutive days give 0; a first reading, or an interval reaching outside the series, gives null."""
    k = _keys(station)
    c = cumulative_precip(every_day(daily, station), station).select(*k, "ts", F.coalesce("precip_cum", F.lit(0.0)).alias("precip_cum"))
    hi = c.select(*k, F.date_add("ts", 1).alias("ts"), F.col("precip_cum").alias("_hi"))
    lo = c.select(*k, F.col("ts").alias(prev_ts), F.col("precip_cum").alias("_lo"))
    out = _look_up(_look_up(df, hi, ["ts"], station), lo, [prev_ts], station)
    total = F.when(F.datediff("ts", prev_ts) <= 1, F.lit(0.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return out.withColumn("precip_interval", F.when(F.col(prev_ts).isNotNull(), total)).drop("_hi", "_lo")


def previous_date(df: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    """Add the entity's previous distinct reading date (day grain, then joined back)."""
    days = df.select(entity, ts).distinct()
    days = days.withColumn("prev_ts", F.lag(ts).over(Window.partitionBy(entity).orderBy(ts)))
    return df.join(days, [entity, ts], "left")


def weather_variable_audit(daily: DataFrame, cols=DAILY_VARIABLES, code: float = -990.0, station: str | None = None) -> DataFrame:
    """Per variable, and station: row, code and null counts and the range of the valid values. Median comes from `quantiles`."""
    k = _keys(station)
    long = daily.unpivot(k, cols, "variable", "v")
    ok = F.when(F.col("v") > code, F.col("v"))
    return long.groupBy(*k, "variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") <= code).alias("codes"),
        F.count_if(F.col("v").isNull()).alias("nulls"), F.min(ok).alias("v_min"), F.avg(ok).alias("v_mean"),
        F.median(ok).alias("v_median"), F.max(ok).alias("v_max"))


def weather_coverage(readings: DataFrame, daily: DataFrame, station: str | None = None) -> DataFrame:
    """Share of distinct reading dates, of each station, that have a weather row; a date counts once however many rows it has."""
    k = _keys(station)
    dates = readings.select(*k, "ts").distinct()
    side = daily.select(*k, "ts").distinct().withColumn("hit", F.lit(1.0))
    return _look_up(dates, side, ["ts"], station).groupBy(*k).agg(
        F.count(F.lit(1)).alias("dates"), F.sum(F.coalesce("hit", F.lit(0.0))).cast("bigint").alias("covered"),
        (100 * F.avg(F.coalesce("hit", F.lit(0.0)))).alias("covered_pct"))


def all_null_years(df: DataFrame, cols: list[str]) -> DataFrame:
    """Years in which every listed covariate is null on every row."""
    return df.groupBy("yr").agg(
        *[F.bool_and(F.col(c).isNull()).cast("bigint").alias(f"{c}_all_null") for c in cols])
