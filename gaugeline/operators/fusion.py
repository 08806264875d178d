"""Fit on the training rows, freeze, apply anywhere: observability, weights, imputation, scaling and block fusion.

`FusionFit.fit` runs a handful of aggregates and keeps their one-row result on the driver, like any fitted model.
`transform` is then a projection: literals and built-in expressions, no join and no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.config import BLOCKS, SUITES
from gaugeline.functions.scalars import DAYS_PER_YEAR, all_present, clip, col
from gaugeline.operators import ordered, quality
from gaugeline.session import durable

BLOCK_NAMES = ["a", "b", "c"]


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians. The table is read several times: written first, if its plan is long."""
    q = ordered.column_quantiles(df, {c: {"m": .5} for c in cols})
    return df.sparkSession.createDataFrame([tuple(q[c]["m"] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


@dataclass(frozen=True)
class Observability:
    """Parameters of the per-row observability of the history block."""

    gap_scale: float = DAYS_PER_YEAR
    saturation: float = 3.0
    base: float = 0.20
    gap_share: float = 0.50
    count_share: float = 0.30
    cold: float = 0.10

    def history_score(self, count="prior_count", gap="gap_days") -> Column:
        return history_score(*[F.lit(float(v)) for v in (self.gap_scale, self.saturation, self.base, self.gap_share, self.count_share, self.cold)],
                             count=count, gap=gap)


def history_score(scale, saturation, base, gap_share, count_share, cold, count="prior_count", gap="gap_days") -> Column:
    """base + gap_share * exp(-days / scale) + count_share * min(n / saturation, 1), or the cold value without history;
    always within [0.05, 1]. Parameters are columns, so a grid of them can be a table."""
    n = F.coalesce(col(count), F.lit(0)).cast("double")
    days = clip(F.coalesce(col(gap), F.lit(3650.0)), 0.0, 3650.0)
    fresh = F.exp(-days / F.greatest(F.lit(1.0), scale))
    full = F.least(n / F.greatest(F.lit(0.1), saturation), F.lit(1.0))
    warm = base + gap_share * fresh + count_share * full
    return F.greatest(F.lit(0.05), F.least(F.when(n > 0, warm).otherwise(cold), F.lit(1.0)))


def observability_v2(df: DataFrame, p: Observability = Observability()) -> DataFrame:
    """avail_a: history; avail_b: previous-year climate present; avail_c: site columns present; avail_d: 0."""
    return (df.withColumn("avail_a", p.history_score()).withColumn("avail_b", F.col("climate_available").cast("double"))
            .withColumn("avail_c", all_present(BLOCKS["c"])).withColumn("avail_d", F.lit(0.0)))


def sample_availability_v1(df: DataFrame) -> DataFrame:
    """First-generation history score: 0.4 + 0.4*exp(-days/730) + 0.2*clip(n/5, 0.2, 1) with days within [0, 3650] (365
    where the gap is missing); 0.25 without history; always within [0.1, 1]."""
    n = F.coalesce(F.col("prior_count"), F.lit(0)).cast("double")
    days = clip(F.coalesce(F.col("gap_days"), F.lit(365.0)), 0.0, 3650.0)
    warm = 0.4 + 0.4 * F.exp(-days / 730.0) + 0.2 * clip(n / 5.0, 0.2, 1.0)
    return (df.withColumn("avail_a", clip(F.when(n > 0, warm).otherwise(F.lit(0.25)), 0.1, 1.0))
            .withColumn("avail_b", F.col("climate_available").cast("double"))
            .withColumn("avail_c", all_present(BLOCKS["c"])).withColumn("avail_d", F.lit(0.0)))


def context_reliability_v1(df: DataFrame, reliability: dict[str, float]) -> DataFrame:
    return df.withColumns({f"ctx_{b}": F.lit(float(reliability.get(b, 0.0))) * F.col(f"avail_{b}") for b in "abcd"})


def adaptive_weights_v1(df: DataFrame, blocks=BLOCK_NAMES) -> DataFrame:
    """w = ctx / sum(ctx); uniform with a flag where nothing is available."""
    total = sum((F.col(f"ctx_{b}") for b in blocks), F.lit(0.0))
    none = total <= 1e-6
    out = {f"w_{b}": F.when(none, F.lit(1.0 / len(blocks))).otherwise(F.col(f"ctx_{b}") / total) for b in blocks}
    out |= {f"w_{b}": F.lit(0.0) for b in "abcd" if b not in blocks}
    return df.withColumns(out | {"fallback": none.cast("bigint")})


def adaptive_weights_v2(df: DataFrame, reliability: dict[str, float], blocks=BLOCK_NAMES, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """g = R^alpha * A^beta with floors of 1e-4, w = g / sum(g); uniform with a flag when the sum is at most 1e-5."""
    g = {b: F.lit(max(1e-4, reliability.get(b, 0.0)) ** alpha) * F.pow(clip(F.col(f"avail_{b}"), 1e-4, 1.0), F.lit(float(beta)))
         for b in blocks}
    total = sum(g.values(), F.lit(0.0))
    none = total <= 1e-5
    out = {f"w_{b}": F.when(none, F.lit(1.0 / len(blocks))).otherwise(g[b] / total) for b in blocks}
    out |= {f"w_{b}": F.lit(0.0) for b in "abcd" if b not in blocks}
    return df.withColumns(out | {"fallback": none.cast("bigint")})


def weight_distribution(df: DataFrame) -> DataFrame:
    return df.agg(*[f(f"w_{b}").alias(f"w_{b}_{n}") for b in "abcd" for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))],
                  F.avg("fallback").alias("fallback_share"))


def impute_with_indicator(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """miss_c flags, then the fitted fill value."""
    flags = {f"miss_{c}": F.col(c).isNull().cast("double") for c in fills}
    return df.withColumns(flags).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def standardize(df: DataFrame, mean: dict[str, float], std: dict[str, float], prefix="z_") -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(mean[c])) / F.lit(std[c] if std[c] > 0 else 1.0) for c in mean})


def robust_outlier(df: DataFrame, column: str, center: float, mad: float, cut: float = 3.5) -> DataFrame:
    """Robust z by median and 1.4826 * MAD (at least 1e-6, so that without spread every deviating row is flagged); null
    scores 0."""
    scale = max(1.4826 * mad, 1e-6)
    z = F.coalesce((F.col(column) - F.lit(center)) / F.lit(scale), F.lit(0.0))
    return df.withColumn(f"robust_z_{column}", z).withColumn(f"outlier_{column}", (F.abs(z) > cut).cast("bigint"))


def fuse_blocks(df: DataFrame, combine: str, blocks: list[str], source_weights: dict[str, float] | None = None) -> DataFrame:
    """fused_c = weight * z_c, the weight being 1, 1/k, a constant per block, or the row's own."""
    total = sum((source_weights or {}).get(b, 0.0) for b in blocks) or 1.0
    w = {"plain": lambda b: F.lit(1.0), "equal": lambda b: F.lit(1.0 / len(blocks)),
         "source": lambda b: F.lit((source_weights or {}).get(b, 0.0) / total), "row": lambda b: F.col(f"w_{b}")}[combine]
    return df.withColumns({f"fused_{c}": w(b) * F.col(f"z_{c}") for b in blocks for c in BLOCKS[b]})


def assemble_features(config: str) -> tuple[list[str], dict[str, int]]:
    """Ordered feature columns of a configuration and their counts by kind."""
    s = SUITES[config]
    blocks = list(s["blocks"])
    base = [f"fused_{c}" for b in blocks for c in BLOCKS[b]]
    rel = [f"rel_{b}" for b in blocks] if s.get("reliability") else []
    meta = [f"avail_{b}" for b in blocks] if s.get("observability") else []
    if s.get("robustness"):
        meta += [f"miss_{c}" for b in blocks for c in BLOCKS[b]]
        meta += ["fallback", "climate_available", "outlier_prev_value", "robust_z_prev_value"]
    weights = [f"w_{b}" for b in blocks] if s.get("weights") else []
    cols = list(dict.fromkeys(base + rel + meta + weights))
    return cols, {"base": len(base), "reliability": len(rel), "metadata": len(meta), "weight": len(weights), "total": len(cols)}


@dataclass(frozen=True)
class FusionFit:
    """Everything learned from the training rows."""

    fills: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]
    center: float
    mad: float
    reliability: dict[str, float]
    count_cuts: tuple[float, float]
    gap_cuts: tuple[float, float]
    observability: Observability = field(default_factory=Observability)

    @staticmethod
    def fit(train: DataFrame, method: str = "geometric", observability: Observability = Observability()) -> "FusionFit":
        cols = [c for b in BLOCK_NAMES for c in BLOCKS[b]]
        train = durable(train.select("entity_id", "yr", "climate_available", *cols), "fusion-train")   # read several times below
        # Medians of all columns, quartiles and cut points of those that need them, in one selection.
        more = {"prev_value": {"q1": .25, "q3": .75}} | dict.fromkeys(("prior_count", "gap_days"), {"lo": .33, "hi": .66})
        q = ordered.column_quantiles(train, {c: {"m": .5} | more.get(c, {}) for c in cols})
        at = lambda c, p: q[c][p]
        fills = {c: float(at(c, "m") or 0.0) for c in cols}
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) for c in cols])
        row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        center = fills["prev_value"]
        off = train.select(F.abs(F.col("prev_value") - F.lit(center)).alias("off"))
        mad = ordered.column_quantiles(off, {"off": {"mad": .5}})["off"]["mad"]
        dims = quality.quality_dimensions_v2(train, quartiles=(at("prev_value", "q1"), at("prev_value", "q3")))
        rel = quality.source_reliability(dims, quality.DIMENSIONS, method).collect()   # 4 rows
        return FusionFit(fills, {c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols}, center, mad or 0.0,
                         {r["block"]: r["reliability"] for r in rel}, *[(at(c, "lo"), at(c, "hi")) for c in ("prior_count", "gap_days")], observability)

    def cohorts(self, df: DataFrame) -> DataFrame:
        n, g = F.col("prior_count"), F.col("gap_days")
        return (df.withColumn("start_type", F.when(n == 0, "cold").otherwise("warm"))
                .withColumn("density_cohort", F.when(n <= self.count_cuts[0], "low").when(n <= self.count_cuts[1], "medium").otherwise("high"))
                .withColumn("gap_cohort", F.when(n == 0, "no_prior").when(g <= self.gap_cuts[0], "short").when(
                    g <= self.gap_cuts[1], "moderate").otherwise("long")))

    def transform(self, df: DataFrame, config: str = "A5", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
        """All derived columns of one configuration, as one projection chain."""
        s = SUITES[config]
        blocks = list(s["blocks"])
        d = observability_v2(df, self.observability)
        d = robust_outlier(d, "prev_value", self.center, self.mad)
        d = adaptive_weights_v2(d, self.reliability, blocks, alpha, beta)
        d = standardize(impute_with_indicator(d, self.fills), self.mean, self.std)
        d = d.withColumns({f"rel_{b}": F.lit(self.reliability[b]) for b in blocks})
        return fuse_blocks(d, s["combine"], blocks, self.reliability)

    def matrix(self, df: DataFrame, config: str, keep: list[str]) -> DataFrame:
        return self.transform(df, config).select(*keep, *assemble_features(config)[0])


def fused_configs(fit: FusionFit, df: DataFrame, configs: list[str], keep: list[str]) -> DataFrame:
    """One long table over configurations (columns a configuration lacks are null), ready for partitionBy('config')."""
    out = None
    for c in configs:
        d = fit.matrix(df, c, keep).withColumn("config", F.lit(c))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def observability_grid(df: DataFrame, scales, saturations, mixtures) -> DataFrame:
    """History score under a parameter grid, summarised per grid point. The grid is a fixed list exploded beside each
    row and folded by the map-side aggregate, so only partial sums per grid point are shuffled."""
    points = F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(float(k)).alias("saturation"), F.lit(float(m[0])).alias("base"),
                                F.lit(float(m[1])).alias("gap_share"), F.lit(float(m[2])).alias("count_share"))
                       for s in scales for k in saturations for m in mixtures])
    long = df.select("prior_count", "gap_days", F.inline(points))
    c = F.col
    score = history_score(c("scale"), c("saturation"), c("base"), c("gap_share"), c("count_share"), F.lit(Observability.cold))
    mix = F.concat_ws("/", c("base").cast("string"), c("gap_share").cast("string"), c("count_share").cast("string"))
    return long.groupBy("scale", "saturation", mix.alias("mixture")).agg(F.avg(score).alias("mean"), F.min(score).alias("v_min"), F.max(score).alias("v_max"))


def exponent_grid(df: DataFrame, reliability: dict[str, float], exponents: list[tuple[float, float]]) -> DataFrame:
    """Mean weights under several (alpha, beta) exponents."""
    obs = observability_v2(df)
    structs = []
    for a, b in exponents:
        g = {m: F.lit(max(1e-4, reliability.get(m, 0.0)) ** a) * F.pow(clip(F.col(f"avail_{m}"), 1e-4, 1.0), F.lit(float(b))) for m in BLOCK_NAMES}
        tot = sum(g.values(), F.lit(0.0))
        structs.append(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), *[(g[m] / tot).alias(f"w_{m}") for m in BLOCK_NAMES]))
    return obs.select(F.inline(F.array(*structs))).groupBy("alpha", "beta").agg(*[F.avg(f"w_{m}").alias(f"w_{m}") for m in BLOCK_NAMES])
