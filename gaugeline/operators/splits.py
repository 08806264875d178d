"""Train/test splits and controlled degradation of inputs. Choices are hash based: the same on any engine and any
number of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import hash_bucket, keyed_text
from gaugeline.operators import ordered


def split_unseen_entities(df: DataFrame, fraction: float = 0.2, seed: int = 42, entity="entity_id") -> DataFrame:
    """ceil(fraction * n) entities held out entirely. Entities are ranked in md5 order bucket by bucket."""
    ids = ordered.hash_rank(df.select(entity).distinct(), entity, str(seed))
    part = F.when(F.col("hash_rank") <= F.ceil(F.lit(fraction) * F.col("n_keys")), "test").otherwise("train")
    return df.join(ids.select(entity, part.alias("split")), entity, "left")


def split_repeated(df: DataFrame, seeds: list[int], fraction: float = 0.2, entity="entity_id") -> DataFrame:
    """(seed, entity, split) for all seeds in one plan: test, then calibration from the rest, then train."""
    ids = df.select(entity).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    r = ordered.hash_rank(ids, entity, F.col("seed"), ["seed"])
    n_test = F.ceil(F.lit(fraction) * F.col("n_keys"))
    n_cal = F.ceil(F.lit(fraction) * (F.col("n_keys") - n_test))
    part = F.when(F.col("hash_rank") <= n_test, "test").when(F.col("hash_rank") <= n_test + n_cal, "calibration").otherwise("train")
    return r.select("seed", entity, part.alias("split"))


def split_temporal(df: DataFrame, train_end: int, test_start: int, valid_start: int | None = None, year="yr") -> DataFrame:
    """Two- or three-way split by year; rows between the parts are dropped."""
    part = F.when(F.col(year) <= train_end, "train").when(F.col(year) >= test_start, "test")
    if valid_start is not None:
        part = part.when(F.col(year) >= valid_start, "validation")
    return df.withColumn("split", part).where("split is not null")


def degrade_inputs(df: DataFrame, cols: list[str], rate: float, mode: str, seed: int, flag: str | None = None,
                   flag_mode: str = "zero", entity="entity_id", row_id="row_id", year="yr") -> DataFrame:
    """Null out a block. `mode`: point (rows), burst_year, burst_entity (whole years or entities), outage (all rows).
    `flag_mode`: zero sets the availability flag to 0 on hit rows, fraction sets it to 1 - rate everywhere."""
    key = {"point": row_id, "burst_year": year, "burst_entity": entity, "outage": None}[mode]
    hit = F.lit(True) if key is None else hash_bucket(keyed_text(key, seed), 1000) < F.lit(int(rate * 1000))
    out = df.withColumn("degraded", hit.cast("bigint")).withColumns({c: F.when(~hit, F.col(c)) for c in cols})
    if flag:
        out = out.withColumn(flag, F.lit(1.0 - rate) * F.col(flag) if flag_mode == "fraction" else F.when(hit, 0.0).otherwise(F.col(flag)))
    return out
