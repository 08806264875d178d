"""Projections, filters and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import all_present, keyed_text, portable_hash

# Canonical names of a prediction table and the spellings met in older files.
PREDICTION_NAMES = {
    "actual": ["actual", "observed", "y_true", "level_observed"],
    "predicted": ["predicted", "prediction", "y_pred", "level_predicted"],
    "error": ["error", "residual", "signed_error"],
    "abs_error": ["abs_error", "absolute_error"],
}


def select_features(df: DataFrame, wanted: list[str], keep: list[str] | None = None) -> DataFrame:
    """Ordered subset, keeping only columns that exist."""
    return df.select(*(keep or []), *[c for c in wanted if c in df.columns])


def harmonize_columns(df: DataFrame, names=None) -> DataFrame:
    """Rename the first present spelling of each canonical column and fill in the derivable ones
    (error = predicted - actual)."""
    low = {c.lower(): c for c in df.columns}
    for canon, spellings in (names or PREDICTION_NAMES).items():
        found = next((low[s] for s in spellings if s in low), None)
        if found and found != canon:
            df = df.withColumnRenamed(found, canon)
    if "error" not in df.columns:
        df = df.withColumn("error", F.col("predicted") - F.col("actual"))
    if "abs_error" not in df.columns:
        df = df.withColumn("abs_error", F.abs("error"))
    return df


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.dropna(subset=subset)


def incomplete_report(df: DataFrame, subset: list[str]) -> DataFrame:
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in subset])
    return df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("rows_kept"),
                  F.count_if(~ok).alias("rows_dropped"))


def filter_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def filter_membership(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_semi")


def filter_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def filter_finite(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def sample_rows(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, repeatable on any engine: the n smallest md5(key_seed). Each task keeps only its
    own n smallest before the merge."""
    h = portable_hash(keyed_text(key, seed))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def filter_by_category(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df.where(F.lower(column) == wanted.lower())


def search_substring(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    hit = [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hit))


def lookup_by_id(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df.where(F.col(column).cast("string") == wanted.strip())


def assign_temporal_split(df: DataFrame, train_end: int, valid_end: int, year="yr", out="split") -> DataFrame:
    return df.withColumn(out, F.when(F.col(year) <= train_end, "train").when(
        F.col(year) <= valid_end, "validation").otherwise("test"))


def binary_availability(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.withColumn(out, all_present(cols))


def depth_class(level="prev_value", count="prior_count", shallow: float = 30.0, deep: float = 100.0) -> F.Column:
    """Depth label of a site with prior readings; sites without any are their own class."""
    return F.when(F.col(count) > 0, F.when(F.col(level) < shallow, "shallow").when(
        F.col(level) <= deep, "intermediate").otherwise("deep")).otherwise("cold_start")


def unique_in_order(array_col: str) -> F.Column:
    return F.array_distinct(array_col)


def feature_catalog(df: DataFrame, blocks: dict[str, list[str]], count="prior_count") -> DataFrame:
    """One row per feature: its block, what its value may depend on, and null counts for rows with and without
    prior readings. One aggregate over the data, then the (tiny) one-row result is unpivoted."""
    cutoff = {"a": "earlier readings", "b": "previous year", "c": "static", "d": "unavailable"}
    present = [(b, c) for b, cols in blocks.items() for c in cols if c in df.columns]
    warm = F.col(count) > 0
    one = df.agg(*[F.count_if(F.col(c).isNull() & (warm if w == "w" else ~warm)).alias(f"{w}_{c}")
                   for _, c in present for w in ("w", "c")])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(b).alias("block"), F.lit(cutoff[b]).alias("known_from"),
                     F.col(f"w_{c}").alias("missing_warm"), F.col(f"c_{c}").alias("missing_cold")) for b, c in present]
    return one.select(F.inline(F.array(*rows)))
