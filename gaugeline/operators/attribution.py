"""Feature attributions in long form: one row per (row, feature) with the feature's value and contribution.

Groups are features (a fixed list), rows are unbounded: statistics over a feature use map-side combined aggregates and
bracketed quantiles; only per-row arrays (bounded by the number of features) are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import safe_corr
from gaugeline.operators import ordered, profile


def linear_attribution(df: DataFrame, coefficients: dict[str, float], intercept: float, keep: list[str]) -> DataFrame:
    """Exact contributions of a linear model: beta * (x - mean). Long form, with the base value and the prediction."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    base = intercept + sum(b * means[c] for c, b in coefficients.items())
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value"), (F.lit(b) * (F.col(c) - F.lit(means[c]))).alias("shap"))
            for c, b in coefficients.items()]
    pred = sum((F.lit(b) * F.col(c) for c, b in coefficients.items()), F.lit(intercept))
    return df.select(*keep, F.lit(base).alias("base_value"), pred.alias("prediction"), F.inline(F.array(*rows)))


def additivity_check(long: DataFrame, key="row_id") -> DataFrame:
    """Largest gap between base + contributions and the prediction."""
    per = long.groupBy(key).agg(F.abs(F.max("base_value") + F.sum("shap") - F.max("prediction")).alias("gap"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.max("gap").alias("worst_gap"), F.count_if(F.col("gap") > 1e-6).alias("violations"))


def global_importance(a: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = [*(keys or []), "feature"]
    m = F.abs("shap")
    base = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(m).alias("mean_abs"), F.stddev_samp(m).alias("std_abs"), F.avg("shap").alias("mean_signed"))
    q = ordered.quantiles(a, m, {"median_abs": .5, "p90_abs": .9}, keys)
    total = F.sum("mean_abs").over(Window.partitionBy(*keys[:-1]))                    # over features: a fixed list
    return base.join(q, keys).withColumn("share_pct", F.when(total > 0, 100 * F.col("mean_abs") / total))


def by_block(a: DataFrame) -> DataFrame:
    f = a.groupBy("block", "feature").agg(F.avg(F.abs("shap")).alias("m"))
    g = f.groupBy("block").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("features"), F.max_by("feature", F.struct(F.col("m"), (-F.col("feature")).alias("t"))).alias("top_feature"))
    grand = F.broadcast(g.agg(F.sum("total").alias("_g")))                            # one row
    return g.crossJoin(grand).withColumn("share_pct", F.try_divide(100 * F.col("total"), F.col("_g"))).drop("_g")


def warm_cold(a: DataFrame, cohort: str, values: tuple) -> DataFrame:
    """Importance per cohort and the shift between them in percent."""
    w = a.groupBy("feature").agg(*[F.avg(F.when(F.col(cohort) == v, F.abs("shap"))).alias(f"mean_abs_{n}") for v, n in zip(values, ("warm", "cold"))])
    return w.withColumn("shift_pct", F.when(F.col("mean_abs_warm") > 0, 100 * (F.col("mean_abs_cold") - F.col("mean_abs_warm")) / F.col("mean_abs_warm")))


def dependence(a: DataFrame) -> DataFrame:
    """Spearman between a feature's value and its contribution."""
    r = profile.rank_correlation(a, [("feature_value", "shap")], ["feature"])
    return r.select("feature", "n", "rho")


def strongest_partner(a: DataFrame, top: int, key="vec_id", min_rows: int = 50) -> DataFrame:
    """For the `top` most important features, the other top feature whose value follows the contribution most.
    Pairs exist only between the chosen features of one row (top * (top - 1) at most)."""
    imp = a.groupBy("feature").agg(F.avg(F.abs("shap")).alias("m"))
    chosen = F.broadcast(imp.orderBy(F.desc("m"), "feature").limit(top).select("feature"))   # `top` rows
    s = a.join(chosen, "feature", "left_semi").groupBy(key).agg(F.collect_list(F.struct("feature", "shap", "feature_value")).alias("f"))
    p = s.select(F.explode("f").alias("x"), F.col("f")).select("x", F.explode("f").alias("y")).where("x.feature <> y.feature")
    g = p.groupBy(F.col("x.feature").alias("feature"), F.col("y.feature").alias("partner")).agg(
        F.count(F.lit(1)).alias("n"), F.abs(safe_corr("x.shap", "y.feature_value")).alias("r")).where(F.col("n") > min_rows)
    best = F.max_by(F.struct("partner", "r"), F.struct(F.col("r"), (-F.col("partner")).alias("t")))
    return g.groupBy("feature").agg(best.alias("b")).select("feature", "b.partner", "b.r")


def error_cohorts(a: DataFrame, errors: DataFrame, key="vec_id") -> DataFrame:
    """Mean |contribution| of each feature on rows of low (<= P50), high (>= P90) and extreme (>= P95) error."""
    cut = F.broadcast(ordered.quantiles(errors, "abs_error", {"_p50": .5, "_p90": .9, "_p95": .95}))     # one row
    j = a.join(errors.select(key, "abs_error").crossJoin(cut), key)
    e, m = F.col("abs_error"), F.abs("shap")
    return j.groupBy("feature").agg(F.avg(F.when(e <= F.col("_p50"), m)).alias("low_error"), F.avg(F.when(e >= F.col("_p90"), m)).alias("high_error"),
                                    F.avg(F.when(e >= F.col("_p95"), m)).alias("extreme_error"))


def dominant_feature(a: DataFrame, entity: str) -> DataFrame:
    g = a.groupBy(entity, "feature").agg(F.avg(F.abs("shap")).alias("m"))
    return g.groupBy(entity).agg(F.max_by("feature", F.struct(F.col("m"), (-F.col("feature")).alias("t"))).alias("dominant"), F.max("m").alias("mean_abs"))


def model_compare(a: DataFrame, model: str, values: list) -> DataFrame:
    return a.groupBy("feature").pivot(model, values).agg(F.avg(F.abs("shap")))


def consistency(a: DataFrame, expected: dict[int, int]) -> DataFrame:
    """Sign of the value-contribution rank correlation against an expected sign."""
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    d = dependence(a).withColumn("expected", F.try_element_at(want, F.col("feature")))
    return d.where("expected is not null").withColumn("consistent", (F.signum("rho") == F.col("expected")).cast("bigint"))


def rank_stability(a: DataFrame, rep: str) -> DataFrame:
    """Rank features per repetition and correlate the rankings of every two repetitions. Both sides have one row per
    (repetition, feature): a fixed list of features times the number of repetitions."""
    imp = a.groupBy(rep, "feature").agg(F.avg(F.abs("shap")).alias("m"))
    r = ordered.average_rank(imp, "m", "rk", [rep]).select(rep, "feature", "rk")
    x, y = r.select(F.col(rep).alias("rep_a"), "feature", F.col("rk").alias("ra")), r.select(F.col(rep).alias("rep_b"), "feature", F.col("rk").alias("rb"))
    p = x.join(y, "feature").where("rep_a < rep_b").groupBy("rep_a", "rep_b").agg(safe_corr("ra", "rb").alias("rho"))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.avg("rho").alias("rho_mean"), F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"))


def top_contributors(a: DataFrame, k: int, key="vec_id") -> DataFrame:
    """The k most positive and k most negative contributions per row, as ordered arrays (a row has a fixed list of
    features, so the collected array is bounded)."""
    per = a.groupBy(key).agg(F.collect_list(F.struct("shap", "feature", "feature_value")).alias("f"), F.sum("shap").alias("total"))
    order = lambda sign: F.array_sort(F.transform(F.filter("f", lambda x: x["shap"] * sign > 0), lambda x: F.struct(
        (-x["shap"] * sign).alias("o"), x["feature"].alias("feature"), x["shap"].alias("shap"), x["feature_value"].alias("feature_value"))))
    return per.select(key, "total", F.slice(order(1), 1, k).alias("positive"), F.slice(order(-1), 1, k).alias("negative"))


def rows_at_positions(df: DataFrame, order: str, key: str, positions: dict[str, str]) -> DataFrame:
    """Rows at given 1-based positions (SQL over `n`) of the (order, key) ranking. The value at the position comes from a
    selection; ties on it are then resolved on the key the same way, so the ranking is never built."""
    vals = ordered.value_at_rank(df, order, positions).first()
    out = None
    for name, rank in positions.items():
        n, v = vals["n"], vals[name]
        if v is None:                          # no rows
            none = df.limit(0).withColumn("prototype", F.lit(name))
            out = none if out is None else out.unionByName(none)
            continue
        r = df.sparkSession.range(1).select(F.expr(rank.replace("n", str(n))).cast("bigint")).first()[0]
        below = df.where(F.col(order) < F.lit(v)).count()
        ties = df.where(F.col(order) == F.lit(v))
        k = ordered.value_at_rank(ties, key, {"k": str(r - below)}).first()["k"]
        row = ties.where(F.col(key).cast("double") == F.lit(k)).withColumn("prototype", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def positional_prototypes(df: DataFrame, error: str, level: str, key: str) -> DataFrame:
    """Typical (middle) and hard (95 %) rows by error, shallowest and deepest by level."""
    mid = rows_at_positions(df, error, key, {"typical": "floor(n * 0.5) + 1", "hard": "floor(n * 0.95) + 1"})
    ends = None
    for name, o in (("shallowest", F.asc(level)), ("deepest", F.desc(level))):
        d = df.orderBy(o, key).limit(1).withColumn("prototype", F.lit(name))
        ends = d if ends is None else ends.unionByName(d)
    return mid.unionByName(ends)


def regime_prototypes(df: DataFrame, error: str, level: str, key: str, cohort: str, values: tuple = ("warm", "cold")) -> DataFrame:
    """The middle and the 95 % row by error of every cohort, and the shallowest and deepest row of all; a cohort without rows has
    none."""
    out = None
    for v in values:
        own = rows_at_positions(df.where(F.col(cohort) == v), error, key, {f"median_{v}": "floor(n / 2) + 1", f"p95_{v}": "floor(n * 0.95) + 1"})
        out = own if out is None else out.unionByName(own)
    for name, o in (("shallowest", F.asc(level)), ("deepest", F.desc(level))):
        out = out.unionByName(df.orderBy(o, key).limit(1).withColumn("prototype", F.lit(name)))
    return out
