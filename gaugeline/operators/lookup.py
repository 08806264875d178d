"""Joins and set operations between monitoring tables.

No join here is a bare cross join of data sized sides. Hints are given only to sides bounded by construction (calendar
years, a fixed scenario list); every other choice is left to AQE, which broadcasts small sides at run time and splits
skewed partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.ordered import top_k_per_group


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in `order` (a group limit runs before the shuffle)."""
    return top_k_per_group(df, 1, order, keys, "_rn").drop("_rn")


def join_entity_year(df: DataFrame, yearly: DataFrame, order: list[str], entity="entity_id", year="yr") -> DataFrame:
    """Left join on (entity, year); duplicate right rows are reduced to the first, so rows never multiply."""
    return df.join(keep_first(yearly, [entity, year], order), [entity, year], "left")


def asof_nearest_year(years: DataFrame, readings: DataFrame, entity="entity_id") -> DataFrame:
    """For each (entity, target year): the last reading of that year, else the first reading of the nearest year.

    `years` holds the target years (a short fixed list). Readings are first reduced to two candidates per
    (entity, year), so what is crossed with the list is bounded by years x years per entity."""
    first = F.min_by("value", F.struct("ts", "row_id")).alias("first_value")
    last = F.max_by("value", F.struct("ts", "row_id")).alias("last_value")
    # among years at the same distance the earlier readings come first
    per_year = readings.groupBy(entity, "yr").agg(first, last)
    pairs = per_year.crossJoin(F.broadcast(years))
    dy = F.abs(F.col("yr") - F.col("target_year"))
    pick = F.min_by(F.when(dy == 0, F.col("last_value")).otherwise(F.col("first_value")), F.struct(dy.alias("d"), F.col("yr")))
    return pairs.groupBy(entity, "target_year").agg(pick.alias("level"), F.min(dy).alias("year_distance"))


def anti_join_rows(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of `left` with no identical row in `right`, nulls equal. The null-safe comparison runs on one text key,
    so the join stays a hash join."""
    def keyed(d):
        return d.withColumn("_k", F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
    return keyed(left).join(keyed(right).select("_k").distinct(), "_k", "left_anti").drop("_k")


def semi_join_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return df.join(dup, keys, "left_semi")


def recover_attribute(df: DataFrame, source: DataFrame, keys: list[str], attribute: str, order: list[str]) -> DataFrame:
    """Re-attach an attribute by exact key after the source was reduced to one row per key."""
    return df.join(keep_first(source, keys, order).select(*keys, attribute), keys, "left")


def join_split_assignment(df: DataFrame, assignment: DataFrame, key="entity_id") -> DataFrame:
    return df.join(assignment, key, "left")


def join_observation_count(df: DataFrame, readings: DataFrame, key="entity_id") -> DataFrame:
    n = readings.groupBy(key).agg(F.count(F.lit(1)).alias("observation_count"))
    return df.join(n, key, "left")


def paired_run_join(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tol: float = 1e-4) -> DataFrame:
    """Match two run logs and report the largest metric difference and whether it stays within tolerance."""
    j = a.alias("a").join(b.alias("b"), keys, "inner")
    diffs = [F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")) for m in metrics]
    j = j.select(*keys, *[d.alias(f"{m}_diff") for m, d in zip(metrics, diffs)],
                 F.greatest(*diffs, F.lit(0.0)).alias("max_diff"))
    return j.withColumn("passed", (F.col("max_diff") < tol).cast("bigint"))


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def split_overlap(df: DataFrame, left: str, right: str, key="entity_id", split="split") -> DataFrame:
    """Number of keys present in both partitions (must be 0)."""
    per = df.groupBy(key).agg(F.bool_or(F.col(split) == left).alias("l"), F.bool_or(F.col(split) == right).alias("r"))
    return per.agg(F.count_if(F.col("l") & F.col("r")).alias("overlap"), F.count_if("l").alias("n_left"),
                   F.count_if("r").alias("n_right"))


def missing_years(readings: DataFrame, entity="entity_id", year="yr") -> DataFrame:
    """One row per absent year inside an entity's observed span. Consecutive observed years are compared, so only the
    gaps are expanded (years are calendar bounded)."""
    y = readings.select(entity, year).distinct()
    nxt = F.lead(year).over(Window.partitionBy(entity).orderBy(year))
    gaps = y.withColumn("_n", nxt).where(F.col("_n") > F.col(year) + 1)
    return gaps.select(entity, F.explode(F.sequence(F.col(year) + 1, F.col("_n") - 1)).alias("missing_year"))


def union_results(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
