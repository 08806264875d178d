"""From predictions to action: relative potential index, scenarios, decision tiers and per-site views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.config import DEMAND_INPUTS, MOISTURE_INPUTS, PRECIP_WINDOWS
from gaugeline.functions.scalars import clean_float, clip, null_skipping_mean, to_metres
from gaugeline.operators import ordered, profile, uncertainty
from gaugeline.operators.lookup import asof_nearest_year
from gaugeline.operators.select import depth_class
from gaugeline.session import durable

SCENARIO_COLUMNS = [f"precip_{n}d" for n in PRECIP_WINDOWS] + ["precip_interval"]

# Tier labels and what follows from them.
TIERS = {
    1: ("Tier 1: rising", "record the rise and keep watching the recovery"),
    2: ("Tier 2: stable", "keep the normal reading cycle"),
    3: ("Tier 3: falling", "review nearby extraction and drought exposure"),
    4: ("Tier 4: uncertain or stale", "read the site again in the field"),
    5: ("Tier 5: new site, favourable", "candidate for instruments"),
    6: ("Tier 6: new site, remote or unfavourable", "second priority"),
}
# Words of a tier text -> display category, colour, potential.
RISK = {("Tier 3", "Falling"): ("Critical", "#EF4444", "Low"), ("Tier 4", "High-Uncertainty"): ("High", "#F97316", "Moderate"),
        ("Tier 2", "Buffered"): ("Moderate", "#EAB308", "Moderate")}
RISK_ELSE = ("Stable", "#10B981", "High")


def potential_index(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Min-max scale eight inputs on the reference rows; 50 * (1 + mean moisture - mean demand). Missing inputs are
    left out of their mean."""
    rng = uncertainty.training_ranges(reference, MOISTURE_INPUTS + DEMAND_INPUTS)

    def score(cols):
        return null_skipping_mean([clip(F.try_divide(F.col(c) - F.lit(rng[c][0]), F.lit(rng[c][1] - rng[c][0])), 0.0, 1.0) for c in cols])

    return (df.withColumn("moisture_score", score(MOISTURE_INPUTS)).withColumn("demand_score", score(DEMAND_INPUTS))
            .withColumn("balance", F.col("moisture_score") - F.col("demand_score"))
            .withColumn("rrpi", F.round(50.0 * (1 + F.col("balance")), 2)))


def scenario_table(reference: DataFrame) -> DataFrame:
    """Four precipitation scenarios as rows: reference median, zero, P75, P95 of every precipitation input."""
    cols = SCENARIO_COLUMNS
    long = reference.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "variable", "v")
    q = ordered.quantiles(long, "v", {"p50": .5, "p75": .75, "p95": .95}, ["variable"])
    wide = q.groupBy().agg(*[F.max(F.when(F.col("variable") == c, F.col(p))).alias(f"{p}_{c}") for c in cols for p in ("p50", "p75", "p95")])
    rows = [F.struct(F.lit(s).alias("scenario"), *[(F.lit(0.0) if p is None else F.col(f"{p}_{c}")).alias(c) for c in cols])
            for s, p in (("S1 normal", "p50"), ("S2 dry", None), ("S3 wet", "p75"), ("S4 very wet", "p95"))]
    return wide.select(F.inline(F.array(*rows)))


def scenario_inputs(latest: DataFrame, reference: DataFrame, features: list[str]) -> DataFrame:
    """Latest row of each site under every scenario, with its depth class and extrapolation flag. The scenario table
    has four rows, so the cross with it is a broadcast and grows only with the number of sites."""
    d = latest.drop(*SCENARIO_COLUMNS).crossJoin(F.broadcast(scenario_table(reference)))
    d = uncertainty.out_of_range_count(d, uncertainty.training_ranges(reference, features))
    return d.withColumn("depth_class", depth_class())


def scenario_summary(scored: DataFrame, value="predicted_delta") -> DataFrame:
    warm = durable(scored.where(F.col("prior_count") > 0).select("scenario", "depth_class", value), "scored")      # read twice; its input may be a long plan
    base = warm.groupBy("scenario", "depth_class").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return base.join(ordered.quantiles(warm, value, {"median": .5}, ["scenario", "depth_class"]), ["scenario", "depth_class"])


def decision_tiers(latest: DataFrame, cutoff: DataFrame, nearest: DataFrame, rrpi_median: DataFrame, stale_days: float = 365.0,
                   width_limit: float = 10.0, rise: float = 0.5, near_km: float = 5.0) -> DataFrame:
    """One row per site. `latest` carries prior_count, gap_days, predicted_delta and rrpi; `cutoff` one row with q90;
    `rrpi_median` one row; `nearest` the distance to the nearest other monitored site."""
    d = latest.join(nearest, "entity_id", "left").withColumn("nearest_km", F.round(F.coalesce("nearest_km", F.lit(0.0)), 2))
    d = d.crossJoin(F.broadcast(cutoff.select("q90"))).crossJoin(F.broadcast(rrpi_median.select("rrpi_median")))   # one row each
    warm = F.col("prior_count") > 0
    p = F.col("predicted_delta")
    stale = warm & (F.col("gap_days") > stale_days)
    width = F.round(2 * F.col("q90"), 4)
    tier = (F.when(warm & (stale | (width >= width_limit)), 4).when(warm & (p > rise), 1).when(warm & (p < -rise), 3).when(warm, 2)
            .when((F.col("rrpi") >= F.col("rrpi_median")) & (F.col("nearest_km") < near_km), 5).otherwise(6))
    label = F.lit(None).cast("string")
    action = F.lit(None).cast("string")
    for k, (name, what) in TIERS.items():
        label = F.when(F.col("_t") == k, name).otherwise(label)
        action = F.when(F.col("_t") == k, what).otherwise(action)
    only_warm = lambda c: F.when(warm, c)
    return d.withColumn("_t", tier).select(
        "entity_id", "lat", "lon", "elev", F.when(warm, "warm").otherwise("cold").alias("status"), only_warm(F.col("gap_days")).alias("gap_days"),
        stale.cast("bigint").alias("stale"), only_warm(F.round(p, 4)).alias("predicted_delta"), only_warm(F.round(p - F.col("q90"), 4)).alias("lower_90"),
        only_warm(F.round(p + F.col("q90"), 4)).alias("upper_90"), only_warm(width).alias("width_90"),
        F.when(~warm, F.round("rrpi", 2)).alias("rrpi"), "nearest_km", label.alias("tier"), action.alias("action"))


def risk_category(df: DataFrame, tier="tier") -> DataFrame:
    """Display category from the tier text; tiers 1, 5 and 6 fall to the last branch."""
    def pick(i):
        out = F.lit(RISK_ELSE[i])
        for texts, vals in reversed(list(RISK.items())):
            out = F.when(F.contains(F.col(tier), F.lit(texts[0])) | F.contains(F.col(tier), F.lit(texts[1])), vals[i]).otherwise(out)
        return out
    return df.withColumn("category", pick(0)).withColumn("color", pick(1)).withColumn("recharge_potential", pick(2))


def tier_distribution(matrix: DataFrame) -> DataFrame:
    g = matrix.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(matrix.agg(F.count(F.lit(1)).alias("_all")))                 # one row
    return g.crossJoin(total).select("tier", "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))


def risk_distribution(view: DataFrame) -> DataFrame:
    g = view.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(view.agg(F.count(F.lit(1)).alias("_all")))                   # one row
    return g.crossJoin(total).select("category", "n", F.round(100.0 * F.col("n") / F.col("_all"), 1).alias("pct"))


def kpi_summary(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("sites"), F.sum("observations").alias("observations"), F.round(F.avg("depth"), 2).alias("mean_depth"),
                    F.count_if(F.col("category").isin("Critical", "High")).alias("priority_sites"),
                    F.count_if(F.col("category") == "Critical").alias("critical"), F.count_if(F.contains("tier", F.lit("Tier 1"))).alias("rising"))


def well_decision_view(matrix: DataFrame, readings: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """Serving table: decision matrix, history aggregates with the last six values, and each model's latest estimate.
    Three inputs keyed by site, joined once."""
    h = profile.entity_history_arrays(readings).select(
        "entity_id", F.col("n").alias("observations"), F.col("latest_date").alias("last_observation"), "latest_value", "recent")
    last = F.struct("ts", "row_id")
    est = predictions.groupBy("entity_id").agg(*[F.max_by(F.when(F.col("model") == m, F.col("y_pred")), F.when(F.col("model") == m, last)).alias(f"estimate_{m}") for m in models])
    v = risk_category(matrix.join(h, "entity_id", "left").join(est, "entity_id", "left"))
    delta = clean_float("predicted_delta", 0.0)
    trend = F.concat(F.when(delta >= 0, "+").otherwise(""), F.format_string("%.2f", delta), F.lit(" per year"))
    return v.select(
        "entity_id", F.concat(F.lit("Station "), F.col("entity_id").cast("string")).alias("name"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
        F.round("elev", 1).alias("elevation"), F.round(to_metres("elev"), 1).alias("elevation_m"), F.round("latest_value", 2).alias("depth"),
        F.round(F.col("latest_value") - delta, 2).alias("predicted_depth"), F.round(delta, 3).alias("delta"), trend.alias("trend"),
        F.round(clean_float("lower_90", -5.0), 2).alias("lower_90"), F.round(clean_float("upper_90", 4.5), 2).alias("upper_90"),
        F.round(clean_float("width_90", 9.5), 2).alias("width_90"), "tier", "category", "color", "recharge_potential", "rrpi", "last_observation",
        "observations", "recent", "action", *[f"estimate_{m}" for m in models])


def well_forecast_view(view: DataFrame, readings: DataFrame, years: list[int]) -> DataFrame:
    """Next depth, two-step forecast with bounds, and the value at fixed years (nearest year where there is none)."""
    y = view.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in years])).alias("target_year"))
    s = asof_nearest_year(y, readings).groupBy("entity_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target_year", "level"))), lambda x: x["level"]).alias("series"))   # len(years) values
    two = F.round(F.col("depth") - 2 * F.col("delta"), 2)
    return view.join(s, "entity_id", "left").select(
        "entity_id", "depth", "predicted_depth", F.round(F.col("predicted_depth") - F.abs("lower_90"), 2).alias("depth_lower"),
        F.round(F.col("predicted_depth") + F.abs("upper_90"), 2).alias("depth_upper"), two.alias("two_step"),
        F.round(two - F.abs("lower_90"), 2).alias("two_step_lower"), F.round(two + F.abs("upper_90"), 2).alias("two_step_upper"), "series")
