"""MLlib learners behind one small interface, and the study loops around them.

The driver loops only over fits (seeds, configurations, learners); every fit, prediction and metric is a Spark job.
Training tables are written once per study (`durable`) because tree growing re-reads them many times."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import metrics, ordered
from gaugeline.operators.fusion import medians
from gaugeline.session import durable, scratch_path


def make_learner(name: str, label: str, seed: int = 42, **kw):
    """linear, forest or boosted; keyword arguments override the learner's parameters. For trees: `least` rows of
    a node, the share of `columns` a node may test; for boosted ones also the `step` of a round and the share of `rows` it draws."""
    base = {"featuresCol": "features", "labelCol": label, "predictionCol": "y_pred"}
    if name == "linear":
        return LinearRegression(**base, solver="normal", regParam=kw.get("regParam", 1e-6))
    grow = {"seed": seed, "minInstancesPerNode": kw.get("least", 1)}
    if name == "forest":
        return RandomForestRegressor(**base, **grow, numTrees=kw.get("trees", 20), maxDepth=kw.get("depth", 5), leafCol=kw.get("leaf", ""), featureSubsetStrategy=kw.get("columns", "auto"))
    if name == "boosted":
        return GBTRegressor(**base, **grow, maxIter=kw.get("rounds", 10), maxDepth=kw.get("depth", 3), stepSize=kw.get("step", 0.1), subsamplingRate=kw.get("rows", 1.0), featureSubsetStrategy=kw.get("columns", "all"))
    raise ValueError(f"unknown learner {name}")


@dataclass
class Fitted:
    """A fitted learner with its training medians (MLlib trees take no missing values)."""

    model: PipelineModel
    features: list[str]
    fills: dict[str, float]
    extra: dict = field(default_factory=dict)

    def ready(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])) for c in self.features})

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.ready(df)).drop("features")

    @property
    def estimator(self):
        return self.model.stages[-1]


def training_fills(train: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """What stands for a missing value: the training median, 0 for a feature without values."""
    med = medians(train.where(F.col(target).isNotNull()), features).first().asDict()
    return {c: float(med[c]) if med[c] is not None else 0.0 for c in features}


def needed_fills(train: DataFrame, test: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """The fills of the features that miss a value in a row to be fitted or scored; no other is ever used, and those are 0."""
    missed = set()
    for part in (train, test):
        row = part.where(F.col(target).isNotNull()).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
        missed |= {c for c in features if row[c]}
    own = [c for c in features if c in missed]
    return dict.fromkeys(features, 0.0) | (training_fills(train, own, target) if own else {})


def fit(train: DataFrame, features: list[str], target: str, learner: str, seed: int = 42, fills: dict[str, float] | None = None, **kw) -> Fitted:
    """`fills`: the training medians, where they are known already."""
    train = train.where(F.col(target).isNotNull())
    fills = fills or training_fills(train, features, target)
    f = Fitted(None, features, {c: fills[c] for c in features})
    if learner == "boosted" and not train.sparkSession.sparkContext.getCheckpointDir():     # or the lineage grows with every round
        train.sparkSession.sparkContext.setCheckpointDir(scratch_path(train.sparkSession, "rounds"))
    steps = [VectorAssembler(inputCols=features, outputCol="features"), make_learner(learner, target, seed, **kw)]
    f.model = Pipeline(stages=steps).fit(f.ready(train).select(*features, F.col(target).cast("double").alias(target)))
    return f


def train_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, learner: str, keep: list[str], seed: int = 42, fills: dict[str, float] | None = None, **kw) -> DataFrame:
    """Fit and score; keeps identifiers and adds y_true, y_pred, error and its absolute value."""
    f = fit(train, features, target, learner, seed, fills or needed_fills(train, test, features, target), **kw)
    p = f.predict(test.where(F.col(target).isNotNull()))
    e = F.col("y_pred") - F.col(target)
    return p.select(*keep, F.col(target).cast("double").alias("y_true"), "y_pred", e.alias("error"), F.abs(e).alias("abs_error"))


def study(parts: dict[str, tuple[DataFrame, DataFrame]], feature_sets: dict[str, list[str]], learners: list[str], target: str,
          keep: list[str], seed: int = 42, **kw) -> DataFrame:
    """Every (regime, feature set, learner): one prediction log. The loop is over fits; the log is one lazy union.
    The fills of a regime are taken once for all its models."""
    out, every = None, list(dict.fromkeys(c for own in feature_sets.values() for c in own))
    for regime, (train, test) in parts.items():
        fills = needed_fills(train, test, every, target)
        for sname, features in feature_sets.items():
            for name in learners:
                p = train_predict(train, test, features, target, name, keep, seed, fills, **kw)
                p = p.withColumns({"regime": F.lit(regime), "feature_set": F.lit(sname), "learner": F.lit(name)})
                out = p if out is None else out.unionByName(p)
    return out


def benchmark(cells: dict[tuple[int, str], tuple[DataFrame, DataFrame, list[str]]], learners: dict[str, dict], target: str, keep: list[str], parallelism: int = 4) -> DataFrame:
    """seed, config, learner and the metrics of the run, for every learner in every cell. `cells` maps (seed, config) to training rows, test
    rows and features, `learners` a name to its parameters. Several runs go at a time; each is scored and reduced to its metrics before
    its model is let go, so the driver never holds more models than that. A linear model leaves out features that do not vary, as a
    deviation that is all rounding would scale them to anything."""
    spark = next(iter(cells.values()))[0].sparkSession

    def prepare(at):
        train, test, features = cells[at]
        fills = needed_fills(train, test, features, target)
        filled = [(c, F.coalesce(F.col(c).cast("double"), F.lit(fills[c]))) for c in features]
        ends = train.where(F.col(target).isNotNull()).agg(*[f(x).alias(f"{n}_{c}") for c, x in filled for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
        return fills, [c for c in features if ends[f"lo_{c}"] != ends[f"hi_{c}"]]

    def run(job):
        at, name = job
        train, test, features = cells[at]
        fills, vary = known[at]
        p = train_predict(train, test, vary or features if name == "linear" else features, target, name, keep, at[0], fills, **learners[name])
        return durable(log_metrics(p.withColumns({"seed": F.lit(at[0]), "config": F.lit(at[1]), "learner": F.lit(name)}), ["seed", "config", "learner"]), "run")

    wrap = inheritable_thread_target(spark)
    with ThreadPool(parallelism) as pool:
        known = dict(zip(cells, pool.map(wrap(prepare), cells, chunksize=1)))
        runs = pool.map(wrap(run), [(at, name) for name in learners for at in cells], chunksize=1)
    return reduce(DataFrame.unionByName, runs)


def feature_importance(f: Fitted) -> DataFrame:
    """Importances (absolute coefficients for linear) by feature, largest first: one row per feature."""
    est = f.estimator
    vec = est.featureImportances if hasattr(est, "featureImportances") else est.coefficients
    spark = SparkSession.getActiveSession()
    rows = [(c, float(abs(v))) for c, v in zip(f.features, vec.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def ols_single_feature(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Closed-form least squares of the target on each feature alone: all features in one aggregate."""
    one = df.agg(*[fn(F.col(target), F.col(c).cast("double")).alias(f"{n}_{c}") for c in features
                   for fn, n in ((F.regr_slope, "s"), (F.regr_intercept, "i"), (F.regr_r2, "r"), (F.regr_count, "n"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("slope"),
                                                  F.col(f"i_{c}").alias("intercept"), F.col(f"r_{c}").alias("r2")) for c in features])))


def spatial_clusters(sites: DataFrame, k: int = 5, seed: int = 42, cols=("lat", "lon")) -> DataFrame:
    """Sites with a cluster label from k-means on coordinates scaled by their sample deviation."""
    m = sites.agg(*[fn(c).alias(f"{n}_{c}") for c in cols for fn, n in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    z = sites.withColumns({f"_z{c}": (F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"] or 1.0) for c in cols})
    v = durable(VectorAssembler(inputCols=[f"_z{c}" for c in cols], outputCol="_v").transform(z), "clusters")
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v", *[f"_z{c}" for c in cols])


def leaf_quantiles(train: DataFrame, test: DataFrame, features: list[str], target: str, probs: dict[str, float], keep: list[str], seed: int = 42,
                   trees: int = 20, depth: int = 5) -> DataFrame:
    """Quantile forest: exact quantiles of the training targets per (tree, leaf), averaged over the trees a row falls
    into. The leaf table has at most trees * 2**depth rows, so it is broadcast."""
    f = fit(train, features, target, "forest", seed, trees=trees, depth=depth, leaf="leaf")

    def leaves(df, cols):
        p = f.predict(df.where(F.col(target).isNotNull()))
        return p.select(*cols, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf_id"))

    table = ordered.quantiles(leaves(train, [target]), target, probs, ["tree", "leaf_id"])
    j = leaves(test, [*keep, target]).join(F.broadcast(table), ["tree", "leaf_id"])
    return j.groupBy(*keep, F.col(target).alias("y_true")).agg(*[F.avg(n).alias(n) for n in probs])


def occlusion_attribution(f: Fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    """Contribution of a feature = prediction minus prediction with the feature at its training median. Rows are
    multiplied by the (fixed) feature list and scored in one pass."""
    base = f.predict(df).select(*keep, *f.features, F.col("y_pred").alias("base_value"))
    variants = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value"),
                                  *[(F.lit(f.fills[x]) if x == c else F.col(x)).alias(f"v_{x}") for x in f.features]) for c in f.features])
    long = base.select(*keep, "base_value", F.inline(variants))
    for x in f.features:
        long = long.withColumnRenamed(f"v_{x}", x)
    return f.predict(long).select(*keep, "feature", "feature_value", (F.col("base_value") - F.col("y_pred")).alias("shap"))


def interaction_profile(f: Fitted, df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean and largest absolute second difference of the prediction when two features move from their training median
    to the row's own value, separately and together."""
    variants = []
    for a, b in pairs:
        for ua, ub, sign in ((1, 1, 1.0), (1, 0, -1.0), (0, 1, -1.0), (0, 0, 1.0)):
            vals = [((F.col(c) if (c != a or ua) and (c != b or ub) else F.lit(f.fills[c])).cast("double")).alias(f"v_{c}") for c in f.features]
            variants.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(sign).alias("sign"), *vals))
    long = f.ready(df).select("row_id", F.inline(F.array(*variants)))
    for c in f.features:
        long = long.withColumnRenamed(f"v_{c}", c)
    per = f.predict(long).groupBy("row_id", "a", "b").agg(F.sum(F.col("sign") * F.col("y_pred")).alias("h"))
    return per.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("h")).alias("mean_abs"), F.max(F.abs("h")).alias("max_abs"))


def log_metrics(log: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.regression_metrics(log, keys, percentiles=False)
