"""Profiles of tables: counts, ranges, missing values, duplicates, correlations, bins.

Wide reports run as one aggregate and the one-row result is unpivoted afterwards. Exact percentiles go through
`ordered.quantiles`, which never gathers a group in one task."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import right_closed_bin, safe_corr
from gaugeline.operators import ordered


def _inline(one_row: DataFrame, structs: list) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def dataset_profile(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """One row describing readings with their sites: size, span, extent, value range, duplicates, nulls."""
    j = readings.join(sites, "entity_id", "left")
    cells = sum((F.col(c).isNull().cast("bigint") for c in j.columns), F.lit(0))
    base = j.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities"),
        F.countDistinct("county").alias("counties"), F.min("ts").alias("first_date"), F.max("ts").alias("last_date"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.avg("value").alias("value_mean"), F.sum(cells).alias("null_cells"))
    med = ordered.quantiles(readings, "value", {"value_median": 0.5})
    dup = duplicate_key_report(readings, ["entity_id", "ts"]).select(F.col("extra_rows").alias("duplicate_rows"))
    return base.crossJoin(F.broadcast(med)).crossJoin(F.broadcast(dup))  # one row each


def describe_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "variable", "v")
    base = long.groupBy("variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                        F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    return base.join(ordered.quantiles(long, "v", {"q25": .25, "q50": .5, "q75": .75}, ["variable"]), "variable")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def validate_integrity(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target).isNull()).alias("target_nulls"),
                  F.min(target).alias("target_min"), F.max(target).alias("target_max"), F.avg(target).alias("target_mean"),
                  F.stddev_samp(target).alias("target_std"),
                  F.sum(sum((F.col(c).isNull().cast("bigint") for c in features), F.lit(0))).alias("feature_nulls"))


def observations_per_entity(readings: DataFrame, entity="entity_id") -> DataFrame:
    n = F.count(F.lit(1))
    return readings.groupBy(entity).agg(n.alias("n"), (n > 1).alias("multi"))


def coverage_span(readings: DataFrame, entity="entity_id") -> DataFrame:
    return readings.groupBy(entity).agg(
        F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), F.count(F.lit(1)).alias("n"),
        (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("years_covered"))


def frequency_of_counts(readings: DataFrame, entity="entity_id") -> DataFrame:
    per = readings.groupBy(entity).agg(F.count(F.lit(1)).alias("readings"))
    return per.groupBy("readings").agg(F.count(F.lit(1)).alias("entities"))


def entities_with_missing_years(readings: DataFrame, entity="entity_id") -> DataFrame:
    """Entities whose span holds years without a reading. Distinct years are counted after a (entity, year) reduction."""
    y = readings.select(entity, "yr").distinct()
    per = y.groupBy(entity).agg(F.min("yr").alias("first_year"), F.max("yr").alias("last_year"), F.count(F.lit(1)).alias("years"))
    return per.withColumn("missing", F.col("last_year") - F.col("first_year") + 1 - F.col("years")).where("missing > 0")


def observations_by_year(readings: DataFrame) -> DataFrame:
    return readings.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities"))


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _inline(one, [F.struct(F.lit(c).alias("variable"), F.col(c).alias("nulls"),
                                  (F.lit(100.0) * F.col(c) / F.col("_n")).alias("null_pct")) for c in cols])


def missingness_audit(df: DataFrame, cols: list[str], is_train) -> DataFrame:
    """Null counts and shares in train and test, with the fill value (train median)."""
    flag = is_train.cast("int")
    one = df.withColumn("_t", flag).agg(
        F.count_if(F.col("_t") == 1).alias("_ntr"), F.count_if(F.col("_t") == 0).alias("_nte"),
        *[F.count_if(F.col(c).isNull() & (F.col("_t") == k)).alias(f"{c}_{k}") for c in cols for k in (0, 1)])
    rows = _inline(one, [F.struct(
        F.lit(c).alias("variable"), F.col(f"{c}_1").alias("train_nulls"),
        (F.lit(100.0) * F.col(f"{c}_1") / F.col("_ntr")).alias("train_pct"), F.col(f"{c}_0").alias("test_nulls"),
        (F.lit(100.0) * F.col(f"{c}_0") / F.col("_nte")).alias("test_pct")) for c in cols])
    long = df.where(is_train).unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "variable", "v")
    return rows.join(ordered.quantiles(long, "v", {"fill_value": .5}, ["variable"]), "variable", "left")


def duplicate_key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate rows beyond the first, all rows in duplicate groups, and the number of such groups."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("extra_rows"),
                 F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).alias("rows_in_groups"),
                 F.count_if(F.col("_c") > 1).alias("duplicate_groups"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson for i < j: every pair in one pass."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return _inline(one, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])


def rank_correlation(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Spearman with average ranks over complete pairs. Pairs become a key of one long table, so all pairs are ranked
    by the same two (sliced) passes."""
    keys = list(keys or [])
    s = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
         for a, b in pairs]
    long = df.select(*keys, F.inline(F.array(*s))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    k = [*keys, "a", "b"]
    ranked = ordered.average_rank(ordered.average_rank(long, "x", "rx", k), "y", "ry", k)
    return ranked.groupBy(*k).agg(safe_corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def feature_target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    one = df.agg(*[safe_corr(F.col(c).cast("double"), F.col(target)).alias(c) for c in cols])
    rows = _inline(one, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"), F.abs(F.col(c)).alias("abs_r")) for c in cols])
    return rows.orderBy(F.desc_nulls_last("abs_r"), "feature")


def high_correlation_pairs(df: DataFrame, cols: list[str], threshold: float = 0.80) -> DataFrame:
    return correlation_matrix(df, cols).where(F.abs("r") >= threshold)


def row_completeness(df: DataFrame, cols: list[str], out="completeness") -> DataFrame:
    return df.withColumn(out, sum((F.col(c).isNotNull().cast("double") for c in cols), F.lit(0.0)) / float(len(cols)))


def iqr_bounds(df: DataFrame, column: str, k: float, keys=None) -> DataFrame:
    q = ordered.quantiles(df, column, {"q25": .25, "q75": .75}, keys)
    iqr = F.col("q75") - F.col("q25")
    return q.withColumn("low", F.col("q25") - k * iqr).withColumn("high", F.col("q75") + k * iqr)


def iqr_fences(df: DataFrame, column: str, factors=(1.5, 3.0)) -> DataFrame:
    """Per factor: fences, and rows below, above and inside."""
    v = df.select(F.col(column).alias("_x")).where(F.col(column).isNotNull())
    q = F.broadcast(ordered.quantiles(df, column, {"q25": .25, "q75": .75}))       # one row
    iqr = F.col("q75") - F.col("q25")
    j = v.crossJoin(q).select("_x", F.explode(F.array(*[F.struct(
        F.lit(float(k)).alias("k"), (F.col("q25") - k * iqr).alias("low"), (F.col("q75") + k * iqr).alias("high"))
        for k in factors])).alias("f")).select("_x", "f.*")
    return j.groupBy("k", "low", "high").agg(F.count_if(F.col("_x") < F.col("low")).alias("below"),
                                             F.count_if(F.col("_x") > F.col("high")).alias("above"),
                                             F.count_if(F.col("_x").between(F.col("low"), F.col("high"))).alias("inside"))


def within_fences(df: DataFrame, column: str, k: float) -> DataFrame:
    """The robust subset: rows inside the fences."""
    b = F.broadcast(iqr_bounds(df, column, k).select("low", "high"))               # one row
    return df.crossJoin(b).where(F.col(column).between(F.col("low"), F.col("high"))).drop("low", "high")


def outside_fences(df: DataFrame, column: str, k: float) -> DataFrame:
    b = F.broadcast(iqr_bounds(df, column, k).select("low", "high"))               # one row
    return df.crossJoin(b).where((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).drop("low", "high")


# The percentiles of a change profile.
PROFILE_PROBS = {"p01": .01, "p05": .05, "p10": .10, "p25": .25, "p50": .50, "p75": .75, "p90": .90, "p95": .95, "p99": .99}


def distribution_profile(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    fin = F.when(F.abs(c) < float("inf"), c)
    base = df.agg(F.count(fin).alias("n"), F.count_if(F.abs(c) == float("inf")).alias("n_inf"), F.avg(fin).alias("mean"),
                  F.stddev_samp(fin).alias("std"), F.min(fin).alias("v_min"), F.max(fin).alias("v_max"))
    q = ordered.quantiles(df, fin, PROFILE_PROBS).withColumn("iqr", F.col("p75") - F.col("p25"))
    return base.crossJoin(F.broadcast(q))                                          # one row each


def fixed_bin_summary(df: DataFrame, by: str, value: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Right-closed bins of one column summarising another."""
    b = df.withColumn("bin", right_closed_bin(by, edges, labels)).where("bin is not null").where(F.col(value).isNotNull())
    base = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    q = ordered.quantiles(b, value, {"median": .5, "p90": .9, "p95": .95}, ["bin"])
    return base.join(q, "bin")


def quantile_bins(df: DataFrame, by: str, parts: int, out="bin") -> DataFrame:
    """Label rows with their quantile bin: edges are exact percentiles, intervals right closed, ties stay together."""
    probs = {f"e{i}": i / parts for i in range(1, parts)}
    edges = F.broadcast(ordered.quantiles(df, by, probs))                          # one row
    bin_no = sum((F.when(F.col(by) > F.col(e), 1).otherwise(0) for e in probs), F.lit(1))
    return df.where(F.col(by).isNotNull()).crossJoin(edges).withColumn(out, bin_no).drop(*probs)


def quantile_bin_summary(df: DataFrame, by: str, parts: int, measures: dict[str, str]) -> DataFrame:
    b = quantile_bins(df, by, parts)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("from"), F.max(by).alias("to"),
                                *[F.avg(F.expr(e)).alias(n) for n, e in measures.items()])


def interval_precip_audit(df: DataFrame, gap="gap_days", precip="precip_interval") -> DataFrame:
    base = df.where(F.col(gap).isNotNull() & F.col(precip).isNotNull()).agg(
        F.count(F.lit(1)).alias("pairs"), safe_corr(gap, precip).alias("pearson"), F.max(gap).alias("gap_max"),
        F.max(precip).alias("precip_max"), F.max_by(precip, F.struct(gap, precip)).alias("precip_at_longest_gap"),
        F.count_if(F.col(precip) == 0).alias("zero_intervals"))
    rho = rank_correlation(df, [(gap, precip)]).select(F.col("rho").alias("spearman"))
    return base.crossJoin(F.broadcast(rho))                                        # one row each


def split_feasibility(df: DataFrame, split="split", entity="entity_id", count="prior_count") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(count) > 0).alias("warm"),
                                 F.count_if(F.col(count) == 0).alias("cold"), F.countDistinct(entity).alias("entities"))


def latest_snapshot(df: DataFrame, cols: list[str], entity="entity_id", order=("ts", "row_id")) -> DataFrame:
    """Per entity and column the last non-null value: one map-side combined aggregate, no window."""
    o = F.struct(*order)
    return df.groupBy(entity).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), o)).alias(c)
                                    for c in cols])


def ordered_records(df: DataFrame, entity="entity_id") -> DataFrame:
    """Every reading as a record with its position in the entity's history. Records stay rows: a history of any
    length is never packed into one array."""
    r = df.select(entity, F.struct(F.col("yr").alias("year"), F.col("ts").alias("date"), F.col("value").alias("level")).alias("record"),
                  "ts", "row_id")
    return r.orderBy(entity, "ts", "row_id").select(entity, "record")


def entity_history_arrays(df: DataFrame, tail: int = 6, entity="entity_id") -> DataFrame:
    """Per entity: number of readings, latest date and value, and the last `tail` values oldest first. The array is
    bounded by `tail`; a per-task group limit keeps hot entities from reaching one task whole."""
    o = [F.desc("ts"), F.desc("row_id")]
    last = ordered.top_k_per_group(df, tail, o, [entity], "_k").groupBy(entity).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "row_id", "value"))), lambda x: x["value"]).alias("recent"))
    base = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest_date"),
                                  F.max_by("value", F.struct("ts", "row_id")).alias("latest_value"))
    return base.join(last, entity)


def table_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-independent content hash: row count and the (wide) sum of a 32-bit md5 prefix of every row's text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def best_per_group(df: DataFrame, keys: list[str], score, cols: list[str], tiebreak: str) -> DataFrame:
    """The row with the highest score per group, smallest tiebreak first on ties."""
    return ordered.top_k_per_group(df, 1, [F.desc_nulls_last(score), tiebreak], keys, "_k").select(*keys, *cols)
