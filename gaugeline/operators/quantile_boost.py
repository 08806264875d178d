"""Gradient boosting on the pinball loss, for several quantiles at once.

Every round grows a shallow tree per quantile on the sign of the residuals (the gradient of the pinball loss) and then
re-sets its leaves to the exact quantile of the residuals in them; the leaves of all quantiles are one keyed selection. The
current predictions are written after each round, so a round's plan is one scan and a lost executor costs one round. A
model is trees and leaf tables of at most 2^depth values. Predicted quantiles of a row are put in ascending order at the end, so
they never cross and the loss only falls by it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import ordered
from gaugeline.operators.fusion import medians
from gaugeline.session import durable


def pinball(y: Column, q: Column, p: float) -> Column:
    """Loss of predicting the p-quantile as q."""
    return F.when(y >= q, F.lit(p) * (y - q)).otherwise(F.lit(p - 1) * (y - q))


@dataclass
class QuantileBoost:
    """Fitted quantile model: first values, then per round and quantile a tree with its leaf values."""

    features: list[str]
    fills: dict[str, float]
    probs: dict[str, float]
    start: dict[str, float]
    rate: float
    rounds: list[dict] = field(default_factory=list)

    def assembled(self, df: DataFrame, keep: list[str]) -> DataFrame:
        x = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(self.fills[c])).alias(f"_x_{c}") for c in self.features]
        v = VectorAssembler(inputCols=[f"_x_{c}" for c in self.features], outputCol="_features").transform(df.select(*keep, *x))
        return v.select(*keep, "_features")

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and one column per quantile, ascending in every row."""
        d = self.assembled(df, keep)
        sums = {n: F.lit(self.start[n]) for n in self.probs}
        for i, step in enumerate(self.rounds):
            for n, (tree, leaves) in step.items():
                leaf = f"_leaf_{i}_{n}"
                d = tree.copy({tree.leafCol: leaf, tree.predictionCol: ""}).transform(d)
                sums[n] = sums[n] + F.lit(self.rate) * _leaf_value(F.col(leaf), leaves)
        names = sorted(self.probs, key=self.probs.get)
        rows = d.select(*keep, F.array_sort(F.array(*[sums[n] for n in names])).alias("_q"))
        return rows.select(*keep, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _leaf_value(leaf: Column, leaves: dict[int, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in sorted(leaves.items()) for x in (float(k), float(v))])
    return F.coalesce(F.try_element_at(table, leaf), F.lit(0.0))


def fit(train: DataFrame, features: list[str], target: str, probs: dict[str, float], rounds: int = 10, depth: int = 3, rate: float = 0.3, seed: int = 42) -> QuantileBoost:
    """Missing features take the training median; rows without a target are left out."""
    train = train.where(F.col(target).isNotNull())
    med = medians(train, features).first().asDict()
    first = ordered.quantiles(train, target, probs).first().asDict()
    m = QuantileBoost(features, {c: float(med[c] or 0.0) for c in features}, dict(probs), {n: float(first[n] or 0.0) for n in probs}, rate)
    y = F.col(target).cast("double")
    state = durable(m.assembled(train, [target]).select("_features", y.alias("_y"), *[F.lit(m.start[n]).alias(f"_p_{n}") for n in probs]), "boost")
    if state.isEmpty():
        return m

    def grow(name: str, number: int):
        p = probs[name]
        grown = DecisionTreeRegressor(featuresCol="_features", labelCol="_g", predictionCol="_t", leafCol="_leaf", maxDepth=depth, seed=seed + number)
        return name, grown.fit(state.select("_features", F.when(F.col("_y") >= F.col(f"_p_{name}"), F.lit(p)).otherwise(F.lit(p - 1)).alias("_g")))

    for number in range(rounds):
        with ThreadPoolExecutor(len(probs)) as pool:
            grown = dict(pool.map(lambda n: grow(n, number), probs))
        placed = state
        for n, tree in grown.items():
            placed = tree.copy({tree.leafCol: f"_l_{n}", tree.predictionCol: ""}).transform(placed)
        long = placed.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_l_{n}").alias("leaf"), (F.col("_y") - F.col(f"_p_{n}")).alias("rest")) for n in probs])))
        step = {n: (grown[n], {}) for n in probs}
        for r in ordered.quantiles(long, "rest", probs, ["name", "leaf"]).collect():                 # 2^depth rows a quantile at most
            step[r["name"]][1][int(r["leaf"])] = r[r["name"]]
        m.rounds.append(step)
        if number + 1 < rounds:
            state = durable(placed.select("_features", "_y", *[(F.col(f"_p_{n}") + F.lit(rate) * _leaf_value(F.col(f"_l_{n}"), step[n][1])).alias(f"_p_{n}") for n in probs]), "boost")
    return m
