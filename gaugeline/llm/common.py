"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\x20\x09-\x0D"                      # what separates words
BATCH_ROWS = 256                              # rows of whole texts that one Arrow batch holds


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of whole texts stay small, as a batch is held in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], out: str) -> DataFrame:
    """Append the columns that `fn` makes of each Arrow batch (`out`: their schema as DDL). Columns of these names that
    are already there are replaced."""
    new = StructType.fromDDL(out)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            made = fn(b)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(made[n] for n in new.names)], [*names, *new.names])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*kept, *new.fields]))


def packed(df: DataFrame, kept: list[str], /, **own: Column) -> DataFrame:
    """The row as one struct beside the columns an operator works with, so that names of its own cannot clash with those
    of the row."""
    return df.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0)])).alias("_row"), *(c.alias(n) for n, c in own.items()))


def unpacked(df: DataFrame, kept: list[str], /, **own: Column) -> DataFrame:
    """The columns of `packed` rows, and new ones."""
    return df.select(*(F.col("_row").getField(c).alias(c) for c in kept), *(c.alias(n) for n, c in own.items()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def in_files(df: DataFrame, size: int, per: int) -> DataFrame:
    """The rows in as few partitions as their `size` needs (`per` in each), so that a small result of many partitions is not written
    as many tiny files. Never more partitions than there are."""
    return df.coalesce(max(1, -(-int(size) // per)))
