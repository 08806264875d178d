"""Leakage and consistency gates: each is a violation count, all are rows of one report.

Gates on the same table share one aggregate; fidelity gates re-derive the value along another path (an equi-join on the
claimed previous date) instead of repeating the window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gaugeline.config import BANNED
from gaugeline.operators import history, profile
from gaugeline.session import durable


def _rows(one: DataFrame, names: list[str]) -> DataFrame:
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("bigint").alias("violations")) for n in names])))


def _count(name: str, cond) -> tuple[str, F.Column]:
    return name, F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def counted(df: DataFrame, checks: list[tuple[str, F.Column]]) -> DataFrame:
    """All row-level checks of one table in one pass."""
    return _rows(df.agg(*[c for _, c in checks]), [n for n, _ in checks])


def schema_gates(df: DataFrame, features: list[str], target: str) -> DataFrame:
    low = {c.lower() for c in features}
    checks = {"target_absent": int(target.lower() in low), "banned_absent": len(low & {b.lower() for b in BANNED}),
              "features_present": sum(f not in df.columns for f in features)}
    return df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("gate"), F.lit(v).cast("bigint").alias("violations")) for k, v in checks.items()])))


def write_checked(df: DataFrame, path: str, checks: list[tuple[str, F.Column]]) -> DataFrame:
    """Write a table and count its gates in the same job, on the rows as they pass: the report of `counted`, without a scan of its own.
    The counts are an `Observation`, a row whatever the table."""
    seen = Observation("gates")
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c for _, c in checks]).write.parquet(path)
    got = seen.get
    return df.sparkSession.createDataFrame([(n, int(got[n] or 0)) for n, _ in checks], "gate string, violations bigint")


def history_gates(rows: DataFrame) -> DataFrame:
    """Row-level gates of a history table."""
    return counted(rows, history_checks())


def history_checks() -> list[tuple[str, F.Column]]:
    c = F.col
    return [
        _count("gap_positive", c("gap_days") <= 0),
        _count("cold_start_nulls", (c("prior_count") == 0) & (c("prev_value").isNotNull() | c("gap_days").isNotNull() | c("hist_mean").isNotNull())),
        _count("warm_has_previous", (c("prior_count") > 0) & c("prev_value").isNull()),
        _count("history_bounds", (c("hist_min") > c("prev_value")) | (c("hist_max") < c("prev_value"))),
        _count("density_bounds", (c("density") < 0) | (c("density") * 3 > c("prior_count") + 1e-9)),
        _count("flag_order", c("very_long_gap") > c("long_gap")),
    ]


def fidelity_gates(rows: DataFrame, readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """The claimed previous date exists, carries the claimed mean, and no other reading lies between."""
    days = history.day_table(readings, entity, ts, value)
    after = F.lead(ts).over(history._by_day(entity, ts))
    days = days.select(entity, F.col(ts).alias("_pt"), F.col("day_mean").alias("_pm"), after.alias("_next"))
    per_day = rows.groupBy(entity, ts).agg(
        F.max("prev_value").alias("prev_value"), F.max("gap_days").alias("gap_days"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("prev_value").isNull()).alias("_nulls"), F.min("prev_value").alias("_lo"))
    claim = per_day.withColumn("_pt", F.date_sub(ts, F.col("gap_days").cast("int")))
    j = claim.join(days, [entity, "_pt"], "left")
    has = F.col("gap_days").isNotNull()
    return counted(j, [
        _count("previous_date_exists", has & F.col("_pm").isNull()),
        _count("previous_value_matches", has & (F.abs(F.col("_pm") - F.col("prev_value")) > 1e-9)),
        _count("nothing_in_between", has & (F.col("_next") != F.col(ts))),
        _count("same_date_consistent", (F.col("_lo") != F.col("prev_value")) | ((F.col("_nulls") > 0) & (F.col("_nulls") < F.col("_n")))),
    ])


def covariate_gates(rows: DataFrame) -> DataFrame:
    return counted(rows, covariate_checks(rows.columns))


def covariate_checks(columns: list[str]) -> list[tuple[str, F.Column]]:
    c = F.col
    checks = []
    if "climate_year" in columns:
        checks += [_count("climate_prior_year", c("climate_year") != c("yr") - 1)]
    if "cutoff" in columns:
        checks += [_count("cutoff_before_date", c("cutoff") >= c("ts"))]
    return checks


def split_gates(assignment: DataFrame, entity="entity_id", split="split", keys: list[str] | None = None) -> DataFrame:
    """Every entity lies in exactly one part (of one repetition)."""
    keys = list(keys or [])
    per = assignment.groupBy(*keys, entity).agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
    return counted(per, [_count("entity_overlap", F.col("_a") != F.col("_b"))])


def temporal_gate(rows: DataFrame, split="split", ts="ts") -> DataFrame:
    """Last training date before first validation date before first test date."""
    m = rows.agg(*[f(F.when(F.col(split) == s, F.col(ts))).alias(f"_{n}_{s}") for s in ("train", "validation", "test") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    bad = (F.col("_hi_train") >= F.col("_lo_validation")) | (F.col("_hi_validation") >= F.col("_lo_test"))
    return _rows(m.select(F.coalesce(bad, F.lit(False)).cast("int").alias("temporal_order")), ["temporal_order"])


def weight_gates(rows: DataFrame) -> DataFrame:
    return counted(rows, weight_checks())


def weight_checks() -> list[tuple[str, F.Column]]:
    w = [F.col(f"w_{b}") for b in "abcd"]
    total = reduce(lambda a, b: a + b, w)
    return [
        _count("weights_sum_to_one", F.abs(total - 1) > 1e-9),
        _count("empty_block_weight_zero", F.col("w_d") != 0),
        _count("weights_in_unit_interval", reduce(lambda a, b: a | b, [(x < 0) | (x > 1) | x.isNull() for x in w])),
        _count("availability_in_unit_interval", reduce(lambda a, b: a | b, [(F.col(f"avail_{b}") < 0) | (F.col(f"avail_{b}") > 1) for b in "abcd"])),
    ]


def partition_gates(split: DataFrame, entity="entity_id", part="split") -> DataFrame:
    """Calibration and test share no entity, and no part lacks one."""
    parts = ("train", "calibration", "test")
    per = split.groupBy(entity).agg(*[F.count_if(F.col(part) == p).alias(f"_{p}") for p in parts])
    empty = sum(F.when(F.count_if((F.col(f"_{p}") > 0) & F.col(entity).isNotNull()) == 0, 1).otherwise(0) for p in parts)
    return counted(per, [_count("calibration_test_disjoint", (F.col("_calibration") > 0) & (F.col("_test") > 0)), ("parts_filled", empty.alias("parts_filled"))])


def cluster_gates(rows: DataFrame, entity="entity_id", cluster="cluster") -> DataFrame:
    """Every entity lies in one cluster, so holding out a cluster holds out whole entities."""
    per = rows.groupBy(entity).agg(F.min(cluster).alias("_a"), F.max(cluster).alias("_b"), F.count_if(F.col(cluster).isNull()).alias("_n"))
    return counted(per, [_count("cluster_isolation", (F.col("_a") != F.col("_b")) | (F.col("_n") > 0))])


def second_lag_gates(rows: DataFrame, readings: DataFrame, entity="entity_id", ts="ts", value="value") -> DataFrame:
    """The claimed second-last level is the mean of the day before the previous day: found again by the previous day's own claim."""
    per_day = durable(rows.groupBy(entity, ts).agg(F.max("prev_value").alias("_p1"), F.max("prev2_value").alias("_p2"), F.max("gap_days").alias("_g")), "claims")     # read twice; its input may be a long plan
    claim = per_day.withColumn("_pt", F.date_sub(ts, F.col("_g").cast("int")))
    earlier = per_day.select(entity, F.col(ts).alias("_pt"), F.col("_p1").alias("_expected"))
    j = claim.join(earlier, [entity, "_pt"], "left")
    return counted(j, [_count("second_lag_matches", F.col("_g").isNotNull() & (~F.col("_p2").eqNullSafe(F.col("_expected"))) & (F.coalesce(F.abs(F.col("_p2") - F.col("_expected")), F.lit(1.0)) > 1e-9))])


def interval_gates(rows: DataFrame, low="lower_90", high="upper_90", wide_low="lower_95", wide_high="upper_95") -> DataFrame:
    c = F.col
    return counted(rows, [_count("bounds_ordered", c(low) > c(high)),
                          _count("bounds_nested", (c(wide_low) > c(low) + 1e-9) | (c(wide_high) < c(high) - 1e-9))])


def conservation_gates(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and the multiplicity of every key survive a transformation."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    j = b.join(a, keys, "full_outer")
    one = j.agg(F.abs(F.sum(F.coalesce("_b", F.lit(0))) - F.sum(F.coalesce("_a", F.lit(0)))).alias("rows_conserved"),
                F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("key_frequency_conserved"))
    return _rows(one, ["rows_conserved", "key_frequency_conserved"])


def same_rows_gate(log: DataFrame, config="config", row_id="row_id", seed="seed") -> DataFrame:
    """Every configuration of a repetition was scored on the same rows: rows seen by fewer configurations than exist."""
    n = F.broadcast(log.select(seed, config).distinct().groupBy(seed).agg(F.count(F.lit(1)).alias("_all")))  # one row per repetition
    per = log.groupBy(seed, row_id).agg(F.count(F.lit(1)).alias("_seen")).join(n, seed)
    return counted(per, [_count("same_test_rows", F.col("_seen") != F.col("_all"))])


def determinism_gate(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Two builds of a table have the same content hash."""
    fa = profile.table_fingerprint(a, cols)
    fb = profile.table_fingerprint(b, cols).select(F.col("fingerprint").alias("_fb"), F.col("rows").alias("_rb"))
    j = fa.crossJoin(F.broadcast(fb))                                               # one row each
    bad = (F.col("fingerprint") != F.col("_fb")) | (F.col("rows") != F.col("_rb"))
    return _rows(j.select(bad.cast("int").alias("deterministic")), ["deterministic"])


def report(parts: list[DataFrame]) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
