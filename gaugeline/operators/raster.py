"""Yearly grids as long cell tables (yr, r, c, cell) with a metadata table per year; no image codec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import metrics, ordered

FLIPS = ["native", "vertical", "horizontal", "both"]


def cell_index(points: DataFrame, left: float, top: float, res_x: float, res_y: float, lat="lat", lon="lon") -> DataFrame:
    """Row and column of the cell holding each point, by the affine transform."""
    return (points.withColumn("r", F.floor((F.lit(top) - F.col(lat)) / F.lit(res_y)).cast("int"))
            .withColumn("c", F.floor((F.col(lon) - F.lit(left)) / F.lit(res_x)).cast("int")))


def sample_at_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Equi-join on (year, row, column): points outside the grid or on empty cells get null."""
    return points.join(cells.select("yr", "r", "c", "cell"), ["yr", "r", "c"], "left")


def yearly_stats(cells: DataFrame) -> DataFrame:
    base = cells.groupBy("yr").agg(F.count("cell").alias("valid"), F.count_if(F.col("cell").isNull()).alias("empty"), F.min("cell").alias("v_min"),
                                   F.max("cell").alias("v_max"), F.avg("cell").alias("mean"), F.stddev_pop("cell").alias("std"))
    return base.join(ordered.quantiles(cells, "cell", {"median": .5}, ["yr"]), "yr")


def grid_consistency(meta: DataFrame, cols=("width", "height", "crs", "res_x", "res_y", "left", "top"), tol: float = 1e-9) -> DataFrame:
    """Each year's grid against the first year's: sizes and reference system equal, numbers within tolerance."""
    first = meta.agg(*[F.min_by(c, "yr").alias(f"_{c}") for c in cols])              # one row
    j = meta.crossJoin(F.broadcast(first))
    numeric = {f.name for f in meta.schema.fields if f.dataType.typeName() == "double"}
    same = [F.abs(F.col(c) - F.col(f"_{c}")) <= tol if c in numeric else F.col(c) == F.col(f"_{c}") for c in cols]
    flags = [s.cast("bigint").alias(f"same_{c}") for s, c in zip(same, cols)]
    every = same[0]
    for s in same[1:]:
        every = every & s
    return j.select("yr", *flags, every.cast("bigint").alias("consistent"))


def flipped_points(points: DataFrame, height: int, width: int) -> DataFrame:
    """Each point under the four orientations of the grid."""
    r, c = F.col("r"), F.col("c")
    o = [F.struct(F.lit("native").alias("orientation"), r.alias("r"), c.alias("c")),
         F.struct(F.lit("vertical").alias("orientation"), (height - 1 - r).alias("r"), c.alias("c")),
         F.struct(F.lit("horizontal").alias("orientation"), r.alias("r"), (width - 1 - c).alias("c")),
         F.struct(F.lit("both").alias("orientation"), (height - 1 - r).alias("r"), (width - 1 - c).alias("c"))]
    return points.withColumn("_o", F.explode(F.array(*o))).drop("r", "c").select("*", "_o.*").drop("_o")


def orientation_diagnostic(points: DataFrame, cells: DataFrame, height: int, width: int, keys=("orientation",), y="value") -> DataFrame:
    """Agreement of observations with the grid under each flip. Predictions stay paired with their own observation."""
    s = sample_at_points(flipped_points(points, height, width), cells).where("cell is not null")
    return metrics.regression_metrics(s, list(keys), y, "cell", percentiles=False)


def choose_orientation(diagnostic: DataFrame) -> DataFrame:
    return diagnostic.orderBy(F.desc(F.abs("pearson")), "orientation").limit(1)


# Residual thresholds of the validation report.
THRESHOLDS = [10, 25, 50, 100]


def corrected_validation(samples: DataFrame, keys=("yr",), y="value") -> DataFrame:
    """Residual statistics per year with counts of residuals beyond fixed thresholds."""
    s = samples.where("cell is not null")
    m = metrics.regression_metrics(s, list(keys), y, "cell", percentiles=False)
    over = s.groupBy(*keys).agg(*[F.count_if(F.abs(F.col("cell") - F.col(y)) > t).alias(f"over_{t}") for t in THRESHOLDS])
    return m.join(over, list(keys))
