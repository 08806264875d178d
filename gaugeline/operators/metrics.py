"""Prediction quality. Error is predicted minus actual everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import safe_corr
from gaugeline.operators import ordered

# Two-sided 95 % Student t quantiles for 1 to 30 degrees of freedom; the normal value.
T_975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
         2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
Z_975 = 1.959964


def _aggs(y: str, p: str) -> list:
    e = F.col(p) - F.col(y)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return [
        F.count(F.lit(1)).alias("n"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("mean_error"),
        F.stddev_samp(e).alias("error_std"),
        F.max(F.abs(e)).alias("max_abs"),
        F.when((F.var_pop(y) > 0) & (F.var_pop(p) > 0), safe_corr(y, p)).otherwise(F.lit(0.0)).alias("pearson"),
    ]


def regression_metrics(df: DataFrame, keys: list[str] | None = None, y="y_true", p="y_pred", percentiles=True) -> DataFrame:
    """R2 (null without target variance), MAE, RMSE, bias, spread, Pearson (0 without variance) and the median, P90
    and P95 of the absolute error, per group."""
    keys = list(keys or [])
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    base = df.groupBy(*keys).agg(*_aggs(y, p))
    if not percentiles:
        return base
    q = ordered.quantiles(df, F.abs(F.col(p) - F.col(y)), {"medae": .5, "p90": .9, "p95": .95}, keys)
    return base.join(q, keys) if keys else base.crossJoin(F.broadcast(q))          # one row each


def metrics_by_cohort_sets(df: DataFrame, group: list[str], cohort: str, y="y_true", p="y_pred") -> DataFrame:
    """Overall and per-cohort metrics in one report through grouping sets."""
    g = [F.col(c) for c in group]
    out = df.groupingSets([[*g, F.col(cohort)], g], *g, F.col(cohort)).agg(
        F.grouping(cohort).alias("_all"), *_aggs(y, p))
    return out.withColumn(cohort, F.when(F.col("_all") == 1, "overall").otherwise(F.col(cohort))).drop("_all")


def generalization_gap(metrics: DataFrame, near: str, far: str, key="model", split="split") -> DataFrame:
    """R2 lost and MAE gained from the near split to the far one."""
    w = metrics.where(F.col(split).isin(near, far)).groupBy(key).pivot(split, [near, far]).agg(
        F.first("r2").alias("r2"), F.first("mae").alias("mae"))
    return w.select(key, (F.col(f"{near}_r2") - F.col(f"{far}_r2")).alias("r2_drop"),
                    (F.col(f"{far}_mae") - F.col(f"{near}_mae")).alias("mae_increase"))


def error_driver_correlation(df: DataFrame, drivers: list[str], keys=("model",), y="y_true", p="y_pred") -> DataFrame:
    e = F.abs(F.col(p) - F.col(y))
    return df.groupBy(*keys).agg(*[safe_corr(F.col(d).cast("double"), e).alias(f"r_{d}") for d in drivers])


def summarize(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean, sample std, min and max of each metric over repetitions (seeds or folds)."""
    long = metrics.unpivot(keys, names, "metric", "v")
    return long.groupBy(*keys, "metric").agg(F.count("v").alias("runs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                             F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def t_quantile(dof) -> F.Column:
    """Table values up to 30 degrees of freedom, then the expansion around the normal value in powers of 1 / dof, which
    is good to five decimals there."""
    table, z = F.array(*[F.lit(t) for t in T_975]), Z_975
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    series = sum((F.lit(t) / F.pow(dof.cast("double"), F.lit(float(i + 1))) for i, t in enumerate(terms)), F.lit(z))
    return F.when(dof < 1, F.lit(None)).when(dof <= len(T_975), F.try_element_at(table, dof.cast("int"))).otherwise(series)


def t_confidence_interval(metrics: DataFrame, keys: list[str], metric: str) -> DataFrame:
    g = metrics.groupBy(*keys).agg(F.count(metric).alias("runs"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    half = t_quantile(F.col("runs") - 1) * F.col("std") / F.sqrt("runs")
    return g.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def paired_config_delta(metrics: DataFrame, base: str, configs: list[str], metric: str, seed="seed", config="config") -> DataFrame:
    """Per-seed difference to the base configuration, summarised over seeds; positive improvement = smaller metric."""
    wide = metrics.groupBy(seed).pivot(config, [base, *configs]).agg(F.first(metric))
    rows = wide.select(seed, F.inline(F.array(*[F.struct(
        F.lit(c).alias("config"), (F.col(c) - F.col(base)).alias("d"),
        F.try_divide(F.lit(100.0) * (F.col(base) - F.col(c)), F.col(base)).alias("pct")) for c in configs])))
    return rows.groupBy("config").agg(F.count("d").alias("runs"), F.avg("d").alias("delta_mean"), F.stddev_samp("d").alias("delta_std"),
                                      F.min("d").alias("delta_min"), F.max("d").alias("delta_max"), F.avg("pct").alias("improvement_pct"))


def warm_cold_delta(metrics: DataFrame, keys: list[str], names: list[str], cohort="cohort") -> DataFrame:
    """Warm minus cold per repetition."""
    w = metrics.groupBy(*keys).pivot(cohort, ["warm", "cold"]).agg(*[F.first(m).alias(m) for m in names])
    one = len(names) == 1
    return w.select(*keys, *[((F.col("warm") if one else F.col(f"warm_{m}")) - (F.col("cold") if one else F.col(f"cold_{m}"))).alias(f"{m}_delta")
                             for m in names])


def single_vs_repeated(metrics: DataFrame, keys: list[str], metric: str, seed_value: int, seed="seed") -> DataFrame:
    """One seed's value next to the summary of all seeds, and its distance in standard deviations."""
    g = metrics.groupBy(*keys).agg(
        F.max(F.when(F.col(seed) == seed_value, F.col(metric))).alias("single"), F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"), F.min(metric).alias("v_min"), F.max(metric).alias("v_max"))
    return g.withColumn("z", F.when(F.col("std") > 0, (F.col("single") - F.col("mean")) / F.col("std")))


def effect_size(df: DataFrame, base="base_pred", cand="cand_pred", y="y_true", keys=None) -> DataFrame:
    """Cohen's d of the paired absolute-error difference, with RMSE change."""
    d = F.abs(F.col(cand) - F.col(y)) - F.abs(F.col(base) - F.col(y))
    sq = lambda c: F.sqrt(F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y))))
    sd = F.stddev_pop(d)
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"),
                                         F.when(sd > 0, F.avg(d) / sd).otherwise(F.lit(0.0)).alias("cohens_d"),
                                         (sq(cand) - sq(base)).alias("delta_rmse"))


def rank_models(metrics: DataFrame, by="r2") -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last(by))


def relative_degradation(metrics: DataFrame, clean: str, label: str, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """(degraded - clean) / clean of each metric, against the clean row of the same group."""
    keys = list(keys or [])
    ref = metrics.where(F.col(label) == clean).select(*keys, *[F.col(m).alias(f"_{m}") for m in names])
    rest = metrics.where(F.col(label) != clean)
    j = rest.join(ref, keys) if keys else rest.crossJoin(F.broadcast(ref))          # one clean row
    return j.select(*keys, label, *names, *[F.try_divide(F.col(m) - F.col(f"_{m}"), F.col(f"_{m}")).alias(f"{m}_change") for m in names])


def published_metric_recheck(recomputed: DataFrame, reported: DataFrame, keys: list[str], names: list[str], tol: dict[str, float]) -> DataFrame:
    """Compare reported metrics with recomputed ones: per metric the matched rows, the worst gap and the violations."""
    j = recomputed.alias("a").join(reported.alias("b"), keys, "full_outer")
    gaps = [F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")).alias("gap"), F.lit(tol[m]).alias("tol")) for m in names]
    long = j.select(F.inline(F.array(*gaps)))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"), F.max("gap").alias("worst"),
                                      F.count_if(F.coalesce(F.col("gap") > F.col("tol"), F.lit(True))).alias("violations"))
