"""Split-conformal intervals, their evaluation, and applicability of a model to new rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import ordered
from gaugeline.operators.profile import quantile_bins

MIN_STRATUM = 15     # Fixed value: a stratum with fewer calibration rows uses the pooled cut-off.


def rank_rule(alpha: float, rule: str = "textbook") -> str:
    """1-based rank of the cut-off among n scores. `textbook`: the ceil((n+1)(1-alpha))-th smallest.
    `upper`: the next-higher order statistic at level ceil((n+1)(1-alpha))/n, one rank above for large n."""
    keep = repr(1.0 - alpha) + "d"
    k = f"least(ceil((n + 1) * {keep}), n)"
    if rule == "textbook":
        return k
    return f"least(ceil(least(1d, ceil((n + 1) * {keep}) / n) * (n - 1)) + 1, n)"


def conformal_cutoff(scores: DataFrame, score, alphas: dict[str, float], keys: list[str] | None = None, rule: str = "textbook") -> DataFrame:
    """Cut-off per group and level, with the number of calibration scores `n`."""
    return ordered.value_at_rank(scores, score, {k: rank_rule(a, rule) for k, a in alphas.items()}, keys)


LEVELS = {"q90": 0.10, "q95": 0.05}


def conformal_intervals(calibration: DataFrame, target: DataFrame, keys: list[str], stratum: str = "cohort", y="y_true", p="y_pred",
                        rule: str = "textbook", may_pool: tuple[str, ...] = ("cold",)) -> DataFrame:
    """Symmetric intervals by stratum. Cut-offs are one row per (keys, stratum), so joining them is a small-side join.
    Strata of `may_pool` with too few scores, and strata absent from calibration, take the pooled cut-off."""
    score = F.abs(F.col(p) - F.col(y))
    own = conformal_cutoff(calibration, score, LEVELS, [*keys, stratum], rule).where((F.col("n") >= MIN_STRATUM) | ~F.col(stratum).isin(*may_pool))
    pooled = conformal_cutoff(calibration, score, LEVELS, keys, rule)
    own = own.select(*keys, stratum, F.col("q90").alias("_s90"), F.col("q95").alias("_s95"))
    pooled = pooled.select(*keys, F.col("q90").alias("_p90"), F.col("q95").alias("_p95"))
    j = target.join(own, [*keys, stratum], "left")
    j = j.join(pooled, keys, "left") if keys else j.crossJoin(F.broadcast(pooled))   # one row
    for lvl in ("90", "95"):
        q = F.coalesce(f"_s{lvl}", f"_p{lvl}")
        j = (j.withColumn(f"lower_{lvl}", F.col(p) - q).withColumn(f"upper_{lvl}", F.col(p) + q)
             .withColumn(f"width_{lvl}", F.col(f"upper_{lvl}") - F.col(f"lower_{lvl}"))
             .withColumn(f"covered_{lvl}", F.col(y).between(F.col(f"lower_{lvl}"), F.col(f"upper_{lvl}")).cast("double")))
    return j.drop("_s90", "_s95", "_p90", "_p95")


def cqr_intervals(calibration: DataFrame, target: DataFrame, keys: list[str], low: str, high: str, alpha: float = 0.10, y="y_true",
                  rule: str = "textbook", suffix="90") -> DataFrame:
    """Conformalised quantile intervals: widen (or narrow) model quantiles by the cut-off of max(lo - y, y - hi)."""
    score = F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))
    cut = conformal_cutoff(calibration, score, {"_q": alpha}, keys, rule).drop("n")
    j = target.join(cut, keys) if keys else target.crossJoin(F.broadcast(cut))       # one row
    j = j.withColumn(f"cqr_lower_{suffix}", F.col(low) - F.col("_q")).withColumn(f"cqr_upper_{suffix}", F.col(high) + F.col("_q"))
    return (j.withColumn(f"cqr_width_{suffix}", F.col(f"cqr_upper_{suffix}") - F.col(f"cqr_lower_{suffix}"))
            .withColumn(f"cqr_covered_{suffix}", F.col(y).between(F.col(f"cqr_lower_{suffix}"), F.col(f"cqr_upper_{suffix}")).cast("double")).drop("_q"))


def interval_metrics(df: DataFrame, keys: list[str], alpha: float = 0.10, lower="lower_90", upper="upper_90", y="y_true", p="y_pred") -> DataFrame:
    """Coverage, its deviation from nominal, width and error statistics."""
    d = df.withColumn("_w", F.col(upper) - F.col(lower)).withColumn("_e", F.col(p) - F.col(y)).withColumn(
        "_ae", F.abs(F.col(p) - F.col(y))).withColumn("_c", F.col(y).between(F.col(lower), F.col(upper)).cast("double"))
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_c").alias("coverage"), (F.avg("_c") - F.lit(1.0 - alpha)).alias("coverage_deviation"),
        F.avg("_w").alias("mean_width"), F.avg("_ae").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("mean_error"))
    w, e = "_w", "_ae"
    q = ordered.many_quantiles(d, {"median_width": (w, .5), "p90_width": (w, .9), "p95_width": (w, .95), "medae": (e, .5), "p90_ae": (e, .9), "p95_ae": (e, .95)}, keys)
    return base.join(q, keys) if keys else base.crossJoin(F.broadcast(q))                # one row each


def calibration_summary(calibration: DataFrame, keys: list[str], y="y_true", p="y_pred", rule: str = "textbook") -> DataFrame:
    score = F.abs(F.col(p) - F.col(y))
    base = calibration.groupBy(*keys).agg(F.avg(score).alias("mean_residual"))
    med = ordered.quantiles(calibration, score, {"median_residual": .5}, keys)
    cut = conformal_cutoff(calibration, score, LEVELS, keys, rule)
    return (base.join(med, keys).join(cut, keys).withColumn("width_90", 2 * F.col("q90")).withColumn("width_95", 2 * F.col("q95")))


def cqr_vs_conformal(df: DataFrame, keys: list[str], suffix="90") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(f"covered_{suffix}").alias("coverage"), F.avg(f"cqr_covered_{suffix}").alias("cqr_coverage"),
        F.avg(f"width_{suffix}").alias("width"), F.avg(f"cqr_width_{suffix}").alias("cqr_width"),
        (F.avg(f"cqr_width_{suffix}") - F.avg(f"width_{suffix}")).alias("width_change"))


# applicability --------------------------------------------------------------------------------------------------------

def mahalanobis_distance(train: DataFrame, target: DataFrame, cols: list[str], ridge: float = 1e-4, out="mahalanobis") -> DataFrame:
    """Distance to the training mean under the ridge-regularised inverse covariance. The k x k covariance is one
    aggregate; only that matrix is inverted on the driver; scoring is a column expression."""
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inv = np.linalg.inv(cov + ridge * np.trace(cov) * np.eye(k))
    d = [F.col(c) - F.lit(float(row[f"m{i}"])) for i, c in enumerate(cols)]
    sq = sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return target.withColumn(out, F.sqrt(F.greatest(sq, F.lit(0.0))))


def training_ranges(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def out_of_range_count(df: DataFrame, ranges: dict[str, tuple[float, float]], out="out_of_range") -> DataFrame:
    """Number of features outside their training range (a missing value counts as inside) and the any-flag."""
    n = sum((F.when((F.col(c) < lo) | (F.col(c) > hi), 1).otherwise(0) for c, (lo, hi) in ranges.items()), F.lit(0))
    return df.withColumn(out, n.cast("bigint")).withColumn("extrapolative", (F.col(out) > 0).cast("bigint"))


def model_disagreement(log: DataFrame, first: str, second: str, key="row_id", model="model") -> DataFrame:
    """|prediction of one model - prediction of the other| per row: conditional aggregates, one shuffle."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col("y_pred")))
    return log.where(F.col(model).isin(first, second)).groupBy(key).agg(F.abs(pick(first) - pick(second)).alias("disagreement"))


# Right-closed bins of the evidence report.
GAP_BINS = ([-1, 180, 365, 730, 1825, 1e9], ["0-6mo", "6mo-1yr", "1-2yr", "2-5yr", ">5yr"])
SITE_KM_BINS = ([-0.1, 2.0, 5.0, 10.0, 20.0, 100.0], ["0-2km", "2-5km", "5-10km", "10-20km", ">20km"])
COUNT_BINS = ([-1, 0, 5, 15, 30, 1e9], ["0", "1-5", "6-15", "16-30", ">30"])


def evidence(df: DataFrame, signal: str, bin_col, y="y_true", p="y_pred") -> DataFrame:
    d = df.withColumn("bin", bin_col).where("bin is not null").withColumn("_ae", F.abs(F.col(p) - F.col(y)))
    base = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_ae").alias("mae"), F.avg("width_90").alias("mean_width"), F.avg("covered_90").alias("coverage"),
                                F.avg("covered_95").alias("coverage_95"))
    return base.join(ordered.quantiles(d, "_ae", {"medae": .5}, ["bin"]), "bin").withColumn("signal", F.lit(signal))


def quantile_evidence(df: DataFrame, signal: str, parts: int, y="y_true", p="y_pred") -> DataFrame:
    d = quantile_bins(df, signal, parts, "_q")
    return evidence(d.drop("bin"), signal, F.concat(F.lit("Q"), F.col("_q").cast("string")), y, p)
