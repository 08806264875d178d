"""A seeded random order of a whole table, dealt into shards: the two-pass external shuffle.

First pass: every row goes to one of `ceil(bytes / bucket_bytes)` buckets by a seeded hash of its place (file and row
number), so buckets are of a size that one task sorts in memory, whatever the rows hold; copies of a row have places of
their own, so no group of copies is hot. Second pass: a bucket's rows, in order of place, are put into the order that a
Fisher-Yates shuffle of the bucket draws (Spark's `shuffle` of an array, which is one), and written. Buckets follow each
other; the shard and slot of a row follow from the rows of the buckets before and its place in its own. Shards are equal
in rows, to within one row.

Draws are made apart from the texts: one array of numbers per bucket, drawn over a range whose partitions depend on the
bucket count alone. So a task that runs again draws the same, and the same files with the same seed give the same order on
any cluster. The texts are shuffled once.

Nulls, empty and long texts and repeated rows are rows like any other. An empty table gives empty shards. All columns pass
through; an input column that has an output's name is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from gaugeline.llm.common import fresh
from gaugeline.session import durable, scratch_path

BUCKET_BYTES = 16 << 20        # text that a bucket holds, about; a task of the second pass sorts a few buckets
GROUP = 4096                   # buckets whose rows are added up in one window
DRAWS = 64                     # buckets whose draws one task makes


def bucket_sizes(keys: DataFrame) -> DataFrame:
    """(bucket, n, before): rows of a bucket and of all buckets before it; summed in groups, so no window holds more than
    GROUP buckets, or one row a group."""
    n = keys.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.expr(f"bucket div {GROUP}"))
    groups = n.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = groups.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    own = n.withColumn("own", F.sum("n").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n"))
    return own.join(ahead, "part").select("bucket", "n", (F.col("ahead") + F.col("own")).alias("before"))


def draws(spark: SparkSession, buckets: int, widest: int, seed: int) -> DataFrame:
    """(bucket, order): a random order of the numbers 0 to widest - 1 for every bucket. A bucket with fewer rows uses the
    numbers below its count in the order drawn, which is as random."""
    drawn = spark.range(0, buckets, 1, -(-buckets // DRAWS))
    first = F.col("id") * widest
    order = F.shuffle(F.sequence(first, first + (widest - 1)), seed)
    return drawn.select(F.col("id").alias("bucket"), order.alias("order"))


def write(spark: SparkSession, source: str, target: str, shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, columns: list[str] | None = None,
          shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Shuffle the Parquet table at `source` into `shards` folders below `target`; returns the written table: the rows'
    own columns (`columns`: some of them), `slot` (long, without gaps from 0 in every shard, also the order in its files)
    and `shard` (int). `source` and `target` are on storage that all executors share. For rows that are no Parquet
    table yet, write them first (`shuffled`)."""
    table = spark.read.parquet(source)
    own = [c for c in columns or table.columns if c.lower() not in (shard.lower(), slot.lower())]
    meta = table.metadataColumn("_metadata")
    row, text = F.struct(*([F.col(f"`{c}`") for c in own] or [F.lit(0).alias("none")])).alias("row"), [f.name for f in table.schema if f.name in own and isinstance(f.dataType, (StringType, BinaryType))]
    sizes = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in text), F.lit(8 * len(own)).cast("long"))
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(sizes), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    file, place = F.xxhash64(meta["file_path"]), meta["row_index"]
    bucket = F.pmod(F.xxhash64(F.lit(seed), file, place), F.lit(buckets)).alias("bucket")
    counts = durable(bucket_sizes(table.select(bucket)), "buckets")
    widest = max(1, counts.agg(F.max("n")).first()[0] or 1)
    # The bucket's own numbers, in the order drawn, without those it has no rows for.
    drawn = counts.join(draws(spark, buckets, widest, seed).hint("merge"), "bucket").select(
        "bucket", "before", F.expr(f"transform(filter(order, x -> x - bucket * {widest} < n), x -> int(x - bucket * {widest}))").alias("order"))
    scattered = table.select(bucket, file.alias("file"), place.alias("place"), row).repartition(buckets, "bucket")
    ranked = scattered.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("file", "place")))
    # The draws grow with the rows: never a broadcast.
    at = ranked.join(drawn.hint("merge"), "bucket").select("row", (F.col("before") + F.element_at("order", F.col("rank"))).alias("at"))
    n, k = max(rows, 1), fresh(table, "_shard")
    dealt = at.select("row", "at", F.expr(f"at * {shards} div {n}").alias("shard"))
    out = dealt.select(*(F.col("row").getField(c).alias(c) for c in own), F.expr(f"at - (shard * {n} + {shards - 1}) div {shards}").alias(slot), F.col("shard").cast("int").alias(k))
    out.sortWithinPartitions(k, slot).withColumnRenamed(k, shard).write.partitionBy(shard).parquet(target)
    kinds = {f.name: f for f in table.schema}
    return read(spark, target, StructType([*(kinds[c] for c in own), StructField(slot, LongType()), StructField(shard, IntegerType())]))


def read(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The written shards; `where shard = k` reads that shard's files only."""
    return spark.read.schema(schema).parquet(target)


def shuffled(df: DataFrame, target: str, **options) -> DataFrame:
    """`write` for the rows of any query: they are written once first, so each has a place that stays."""
    path = scratch_path(df.sparkSession, "unshuffled")
    df.write.parquet(path)
    return write(df.sparkSession, path, target, **options)
