"""Late, changed and deleted readings carried into a stored history table without rebuilding it.

The stored table has a row per (entity, day) with all history features and the number of earlier days with a mean. A correction names the days it
touched. Per entity only the days from its first touched day on can change; they are rebuilt from the touched days' own
readings, the stored days after, and a seed: running figures at the first touched day, the last three days before it, and the days
its density window reaches. All other rows stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.config import DENSITY_YEARS
from gaugeline.operators import history

OWN = ["day_mean", "day_rows"]


def day_state(readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """The table that `corrected` keeps: day history and `hist_n`, the earlier days that have a mean."""
    d = history.day_history(readings, entity, ts, value)
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("hist_n", F.count("day_mean").over(w))


def touched_days(*changes: DataFrame, entity="entity_id", ts="ts") -> DataFrame:
    """Distinct (entity, day) of changed rows: give each as it was and as it is."""
    out = changes[0].select(entity, ts)
    for c in changes[1:]:
        out = out.unionByName(c.select(entity, ts))
    return out.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).distinct()


def rebuilt(state: DataFrame, readings: DataFrame, touched: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """The rows that replace those of every touched entity from its first touched day on. `readings`: as they are now, all or at least
    those of the touched days."""
    since = touched.groupBy(entity).agg(F.min(ts).alias("_t0"))
    fresh = history.day_table(readings.join(touched, [entity, ts], "left_semi"), entity, ts, value)
    old = state.join(since, entity)
    before, after = old.where(F.col(ts) < F.col("_t0")), old.where(F.col(ts) >= F.col("_t0"))
    days = after.join(touched, [entity, ts], "left_anti").select(entity, ts, *OWN).unionByName(fresh.select(entity, ts, *OWN))
    # The last day before the change, with the figures up to it, is the seed.
    last = Window.partitionBy(entity).orderBy(F.col(ts).desc())
    near = before.withColumn("_k", F.row_number().over(last)).where((F.col("_k") <= 3) | (F.col(ts) >= F.expr(f"_t0 - interval {DENSITY_YEARS} year")))
    n, m2 = F.col("hist_n"), F.coalesce(F.col("hist_std") * F.col("hist_std") * (F.col("hist_n") - 1), F.lit(0.0))
    mean, low, high = F.coalesce("hist_mean", F.lit(0.0)), F.least("hist_min", "day_mean"), F.greatest("hist_max", "day_mean")
    step, has = F.coalesce(F.col("day_mean") - mean, F.lit(0.0)), F.col("day_mean").isNotNull().cast("int")
    seed = near.where("_k = 1").select(entity, (n + has).alias("_n"), (mean + step / (n + 1)).alias("_mean"), (m2 + step * step * n / (n + 1)).alias("_m2"), low.alias("_min"), high.alias("_max"), (F.col("prior_count") + F.col("day_rows")).alias("_rows"))
    both = near.select(entity, ts, *OWN, F.lit(False).alias("_new")).unionByName(days.withColumn("_new", F.lit(True)))
    for part in (history.prior_levels, history.gap_since_previous, history.rolling_last3, history.level_change_trend, history.observation_density):
        both = part(both, entity, ts)
    both = both.join(seed, entity, "left")
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.when(F.col("_new"), F.col(c))
    k, a = F.count(own("day_mean")).over(w), F.avg(own("day_mean")).over(w)
    n0 = F.coalesce("_n", F.lit(0))
    both = both.withColumns({"_k": k, "_a": F.coalesce(a, F.lit(0.0)), "_q": F.coalesce(F.var_pop(own("day_mean")).over(w), F.lit(0.0)), "_lo": F.min(own("day_mean")).over(w), "_hi": F.max(own("day_mean")).over(w),
                             "_r": F.coalesce(F.sum(own("day_rows")).over(w), F.lit(0))}).where("_new")
    total, gap = n0 + F.col("_k"), F.col("_a") - F.coalesce("_mean", F.lit(0.0))
    spread = F.coalesce("_m2", F.lit(0.0)) + F.col("_q") * F.col("_k") + F.when(n0 * F.col("_k") > 0, gap * gap * n0 * F.col("_k") / total).otherwise(0.0)
    done = both.withColumns({
        "hist_mean": F.when(total > 0, (n0 * F.coalesce("_mean", F.lit(0.0)) + F.col("_k") * F.col("_a")) / total), "hist_std": F.when(total > 1, F.sqrt(spread / (total - 1))), "hist_min": F.least("_min", "_lo"), "hist_max": F.greatest("_max", "_hi"),
        "prior_count": (F.coalesce("_rows", F.lit(0)) + F.col("_r")).cast("bigint"), "hist_n": total.cast("bigint")})
    return history.gap_flags(done).select(*state.columns)


def corrected(state: DataFrame, readings: DataFrame, touched: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """The whole table after the correction: untouched rows of `state` and the rebuilt ones."""
    since = touched.groupBy(entity).agg(F.min(ts).alias("_t0"))
    stay = state.join(since, entity, "left").where(F.col("_t0").isNull() | (F.col(ts) < F.col("_t0"))).drop("_t0").select(*state.columns)
    return stay.unionByName(rebuilt(state, readings, touched, entity, ts, value))
