"""Data quality and reliability of feature blocks, from the training rows only.

Every block dimension comes from the same few aggregates over the training rows: one pass of null and range counts, one
bracketed quantile pass for the outlier fences, one (entity, year) reduction for temporal coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.config import BLOCKS
from gaugeline.functions.scalars import clip
from gaugeline.operators import ordered

# Plausible ranges.
REGION_V1 = {"lat": (20.0, 40.0), "lon": (-125.0, -70.0)}
REGION_V2 = {"lat": (15.0, 50.0), "lon": (-130.0, -60.0)}
LEVEL_RANGE = (0.0, 500.0)
DIMENSIONS = ["completeness", "validity", "duplicate", "outlier_quality", "temporal", "spatial"]
APPLICABLE = {"a": DIMENSIONS, "b": DIMENSIONS, "c": [d for d in DIMENSIONS if d != "temporal"], "d": []}


def _null_share(cols: list[str]):
    return F.avg(sum((F.col(c).isNull().cast("double") for c in cols), F.lit(0.0)) / float(len(cols)))


def _between(c: str, bounds) -> F.Column:
    return F.col(c).between(F.lit(bounds[0]), F.lit(bounds[1]))


def _share(cond) -> F.Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def _outlier_share(train: DataFrame, column: str, k: float, quartiles: tuple | None = None) -> DataFrame:
    """One row: share of all rows whose value lies beyond k inter-quartile ranges (`quartiles`, if they are known already)."""
    if quartiles:
        q = train.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in zip(("_q1", "_q3"), quartiles)])
    else:
        q = ordered.quantiles(train, column, {"_q1": .25, "_q3": .75})
    q = F.broadcast(q)                                                              # one row
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col(column) < F.col("_q1") - k * iqr) | (F.col(column) > F.col("_q3") + k * iqr)
    return train.select(column).crossJoin(q).agg(_share(F.coalesce(out, F.lit(False))).alias("outlier_ratio"))


def _rows(one: DataFrame, table: dict[str, dict[str, F.Column | float | None]], cols: list[str]) -> DataFrame:
    def val(v):
        return v if isinstance(v, F.Column) else F.lit(v).cast("double")
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(b).alias("block"), *[val(d.get(c)).alias(c) for c in cols]) for b, d in table.items()])))


def quality_dimensions_v1(train: DataFrame) -> DataFrame:
    a, b, c = BLOCKS["a"], BLOCKS["b"], BLOCKS["c"]
    one = train.agg(
        (1 - _null_share(a)).alias("ca"), (1 - _null_share(b)).alias("cb"),
        _share(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("elev").isNotNull()).alias("cc"),
        _share(F.col("prior_count") > 0).alias("warm"), F.avg("long_gap").alias("lg"), F.avg("density").alias("dens"),
        F.avg("climate_available").alias("avail"),
        ((_share(_between("lat", REGION_V1["lat"])) + _share(_between("lon", REGION_V1["lon"]))) / 2).alias("inside"))
    one = one.crossJoin(F.broadcast(_outlier_share(train, "prev_value", 1.5)))      # one row each
    cols = ["completeness", "temporal", "spatial", "density", "outlier_ratio"]
    return _rows(one, {
        "a": dict(completeness=F.col("ca"), temporal=clip(F.col("warm") * (1 - 0.5 * F.col("lg")), .05, 1.0), spatial=1.0,
                  density=clip(F.col("dens") / 3.0, .1, 1.0), outlier_ratio=F.col("outlier_ratio")),
        "b": dict(completeness=F.col("cb"), temporal=F.col("avail"), spatial=1.0, density=1.0, outlier_ratio=0.0),
        "c": dict(completeness=F.col("cc"), temporal=1.0, spatial=F.col("inside"), density=1.0, outlier_ratio=0.0),
        "d": dict(completeness=0.0, temporal=0.0, spatial=0.0, density=0.0, outlier_ratio=0.0)}, cols)


def quality_dimensions_v2(train: DataFrame, entity="entity_id", quartiles: tuple | None = None) -> DataFrame:
    """Dimensions per block; null where a dimension does not apply, with the applicable ones listed."""
    a, b, c = BLOCKS["a"], BLOCKS["b"], BLOCKS["c"]

    def among_present(cond, present):
        return F.coalesce(F.avg(F.when(present, F.when(cond, 1.0).otherwise(0.0))), F.lit(1.0))

    one = train.agg(
        (1 - _null_share(a)).alias("ca"), (1 - _null_share(b)).alias("cb"), (1 - _null_share(c)).alias("cc"),
        among_present(_between("prev_value", LEVEL_RANGE), F.col("prev_value").isNotNull()).alias("va"),
        among_present(F.col("precip_total") >= 0, F.col("precip_total").isNotNull()).alias("vb"),
        among_present(_between("lat", REGION_V2["lat"]) & _between("lon", REGION_V2["lon"]),
                      F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("vc"),
        F.avg("climate_available").alias("avail"))
    years = train.select(entity, "yr").distinct()
    cover = years.agg((F.count(F.lit(1)) / F.countDistinct(entity) / F.countDistinct("yr")).alias("cover"))
    one = one.crossJoin(F.broadcast(_outlier_share(train, "prev_value", 3.0, quartiles))).crossJoin(F.broadcast(cover))   # one row each
    rows = _rows(one, {
        "a": dict(completeness=F.col("ca"), validity=F.col("va"), duplicate=1.0, outlier_quality=1 - F.col("outlier_ratio"),
                  temporal=clip("cover", .1, 1.0), spatial=1.0),
        "b": dict(completeness=F.col("cb"), validity=F.col("vb"), duplicate=1.0, outlier_quality=1.0, temporal=F.col("avail"), spatial=1.0),
        "c": dict(completeness=F.col("cc"), validity=F.col("vc"), duplicate=1.0, outlier_quality=1.0, spatial=1.0),
        "d": dict(completeness=0.0)}, DIMENSIONS)
    listed = F.lit("")
    for blk, dims in APPLICABLE.items():
        listed = F.when(F.col("block") == blk, ",".join(dims)).otherwise(listed)
    return rows.withColumn("applicable", F.split(listed, ","))


def source_reliability(dimensions: DataFrame, dims: list[str], method: str = "geometric") -> DataFrame:
    """One score per block over its dimensions, each floored at 1e-4. Second generation (an `applicable` list per block):
    exactly the listed dimensions count, so a block whose dimensions are all 0 scores 1e-4 and one without any listed 0.
    First generation: the non-null dimensions count, and a block whose dimensions are all 0 or absent scores 0."""
    listed = "applicable" in dimensions.columns
    if listed:
        vals = F.array(*[F.when(F.array_contains("applicable", d), F.coalesce(F.col(d), F.lit(0.0))) for d in dims])
    else:
        vals = F.array(*[F.col(d) for d in dims])
    vals = F.transform(F.filter(vals, lambda x: x.isNotNull()), lambda x: clip(x, 1e-4, 1.0))
    n = F.size(vals).cast("double")
    total = lambda f: F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + f(x))
    score = {"geometric": F.exp(total(F.log) / n), "arithmetic": total(lambda x: x) / n,
             "harmonic": n / total(lambda x: 1 / x)}[method]
    present = n if listed else sum((F.coalesce(F.col(d), F.lit(0.0)) for d in dims), F.lit(0.0))
    return dimensions.select("block", F.when(present > 0, clip(score, 0.0, 1.0)).otherwise(F.lit(0.0)).alias("reliability"))


def reliability_sensitivity(dimensions: DataFrame, dims: list[str]) -> DataFrame:
    """Three aggregation methods side by side: scores and their normalised weights."""
    out = None
    for m in ("arithmetic", "geometric", "harmonic"):
        r = source_reliability(dimensions, dims, m).groupBy().pivot("block", ["a", "b", "c", "d"]).agg(F.first("reliability"))
        total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
        r = r.select(F.lit(m).alias("method"), *[F.col(x).alias(f"r_{x}") for x in "abcd"],
                     *[F.when(total > 0, F.col(x) / total).otherwise(0.0).alias(f"w_{x}") for x in "abcd"])
        out = r if out is None else out.unionByName(r)
    return out
