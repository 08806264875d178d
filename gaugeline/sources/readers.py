"""Readers: delimited text with or without a preamble, coercion, column contracts, raster cells, nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.config import BANNED
from gaugeline.session import scratch_path  # noqa: F401


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """First path that exists; a clear error when none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these paths exists: {paths}")


def scan_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Headered CSV with a declared schema (no inference pass)."""
    return spark.read.schema(ddl).csv(path, header=True, enforceSchema=False)


def scan_csv_preamble(spark: SparkSession, path: str, ddl: str, header: str = "YEAR,DOY") -> DataFrame:
    """CSV whose column header follows a free-text preamble.

    Data lines are told from preamble lines by shape, not by line number, so files stay splittable: a data line starts
    with a number and has as many fields as the schema."""
    n_fields = len(ddl.split(","))
    lines = spark.read.text(path)
    data = lines.where(F.col("value").rlike(r"^\s*-?\d") & (F.size(F.split("value", ",")) == n_fields)
                       & ~F.col("value").startswith(header))
    return data.select(F.from_csv("value", ddl).alias("r")).select("r.*")


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bad numbers become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def coerce_date(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bad dates become null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in cols})


#: What makes a line or a cell bad.
BAD_LINE, BAD_CELL = "number of fields", "not a {}"


def scan_csv_quarantine(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Headered CSV read line by line: (rows, quarantine). A line with another number of fields than the schema goes to the quarantine
    whole; a cell that is not of its column's type becomes null in its row, and goes there by itself. The quarantine tells
    file, block, line, column (null for a whole line), cell and reason. Rows and quarantined lines add up to all data lines. Lines
    are told apart by shape, so files stay splittable; the header is the line of the column names. Empty cells are missing, not bad;
    blank lines are no lines. Quoted fields may hold commas, not line breaks."""
    kinds = spark.createDataFrame([], ddl).schema
    names = [f.name for f in kinds]
    text = spark.read.text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    data = lines.where((F.trim("value") != "") & (F.trim(F.translate("value", '" ', "")) != F.lit(",".join(names))))
    # As many commas outside quotes as the schema has, so the line parses into its fields.
    fields = F.regexp_count(F.regexp_replace("value", r'"([^"]|"")*"', ""), F.lit(",")) + 1
    cells = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE", "escape": '"', "emptyValue": ""})
    whole = data.where(fields == len(names)).select("value", "file", "block", cells.alias("c"))
    given = lambda f: F.when(F.trim(F.col(f"c.`{f.name}`")) != "", F.trim(F.col(f"c.`{f.name}`")))
    typed = lambda f: given(f) if f.dataType.typeName() == "string" else given(f).try_cast(f.dataType)
    rows = whole.select(*[typed(f).alias(f.name) for f in kinds])
    bad = F.filter(F.array(*[F.struct(F.lit(f.name).alias("column"), given(f).alias("cell"), F.lit(BAD_CELL.format(f.dataType.simpleString())).alias("reason"), (given(f).isNotNull() & typed(f).isNull()).alias("is")) for f in kinds]), lambda x: x["is"])
    wrong = whole.select("file", "block", F.col("value").alias("line"), F.inline(bad)).drop("is")
    short = data.where(fields != len(names)).select("file", "block", F.col("value").alias("line"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("cell"), F.lit(BAD_LINE).alias("reason"))
    return rows, short.unionByName(wrong)


def year_doy_to_date(year, doy) -> F.Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.col(doy) - 1)


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail while the plan is built when a column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def purge_banned(df: DataFrame, banned=tuple(BANNED)) -> DataFrame:
    low = {b.lower() for b in banned}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def reject_banned(df: DataFrame, banned=tuple(BANNED)) -> DataFrame:
    low = {b.lower() for b in banned}
    found = [c for c in df.columns if c.lower() in low]
    if found:
        raise ValueError(f"banned columns among the inputs: {found}")
    return df


def scan_raster_cells(spark: SparkSession, path: str, pattern: str = r"Groundwater_(\d{4})") -> DataFrame:
    """Cell tables, one folder or file per year; the year is read from the path."""
    cells = spark.read.parquet(path)
    return cells.withColumn("yr", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int"))


def read_json_payload(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON object per line, nested arrays of structs included."""
    return spark.read.schema(ddl).json(path)


def write_json_payload(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Write a result table. With partition columns, rows are gathered by those columns and AQE splits a value that is
    larger than its advisory partition size, so the number of writing tasks follows the data."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Insert into an entity table: append files, never rewrite."""
    rows.write.mode("append").parquet(path)
