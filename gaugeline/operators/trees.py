"""Exact Shapley attributions of tree models, from a table of tree paths.

A tree is a table of nodes (tree, weight, node, left, right, feature, threshold, cover, value); a row goes left where its
feature is at most the threshold (missing and NaN values go right). The value of a set of known features is the
prediction in which unknown features follow both branches in proportion to the training rows (cover) there; attributions
are the Shapley values of that game, so they add up to the prediction less the model's mean.

What depends on the trees alone is worked out once, on tables whose size is that of the model: every path from root to leaf
with, per feature on it, the tests it must pass and its share of cover. A row enters only as the outcomes of a tree's
tests, packed into integers. Rows are reduced to the distinct outcomes of each tree (map-side combined) before they meet
the paths; a path then asks which of its features the outcome satisfies (a mask), and the Shapley weights are summed once per
mask. The rows come back by outcome and are summed over trees. No row is ever paired with every leaf."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import durable, scratch_path

BITS = 62                      # tests that one integer holds


def model_nodes(model, features: list[str]) -> DataFrame:
    """Node table of a fitted forest or boosted model (means of a forest become weights of 1 / trees)."""
    from pyspark.sql import SparkSession

    spark, path = SparkSession.getActiveSession(), scratch_path(SparkSession.getActiveSession(), "model")
    model.save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = [w / len(model.treeWeights) if "Forest" in type(model).__name__ else w for w in model.treeWeights]
    name = F.array(*[F.lit(c) for c in features])
    leaf = F.col("leftChild") < 0
    return n.select(F.col("treeID").alias("tree"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("treeID") + 1).alias("weight"), F.col("id").alias("node"),
                    F.when(~leaf, F.col("leftChild")).alias("left"), F.when(~leaf, F.col("rightChild")).alias("right"), F.when(~leaf, F.element_at(name, F.col("split.featureIndex") + 1)).alias("feature"),
                    F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"), F.col("impurityStats")[0].alias("cover"), F.col("prediction").alias("value"))


def tests_of(nodes: DataFrame) -> list[tuple]:
    """Per tree its distinct tests, as [(tree, [(feature, threshold), ...])]: what the driver holds of a model."""
    t = nodes.where("feature is not null").groupBy("tree").agg(F.array_sort(F.collect_set(F.struct("feature", "threshold"))).alias("t"))
    every = nodes.select("tree").distinct().join(t, "tree", "left").orderBy("tree").collect()
    return [(r["tree"], [(x["feature"], x["threshold"]) for x in r["t"] or []]) for r in every]


def _outcome(tests: list[tuple]) -> Column:
    """Outcomes of a tree's tests for a row, as integers of BITS tests each."""
    words = [tests[i:i + BITS] for i in range(0, len(tests), BITS)] or [[]]
    true = lambda f, v: F.coalesce(F.col(f"`{f}`").cast("double") <= F.lit(float(v)), F.lit(False)) & ~F.coalesce(F.isnan(F.col(f"`{f}`").cast("double")), F.lit(False))
    return F.array(*[sum((F.when(true(f, v), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (f, v) in enumerate(w)), F.lit(0).cast("bigint")) for w in words])


def paths(nodes: DataFrame, tests: list[tuple]) -> DataFrame:
    """(tree, leaf, value, slots): weighted value of every leaf and, per feature on its path, the outcome bits it needs set (`yes`)
    and unset (`no`) and its share of cover `z`. One join per level of the trees."""
    spark = nodes.sparkSession
    places = [(t, f, float(v), i // BITS, 1 << (i % BITS)) for t, own in tests for i, (f, v) in enumerate(own)]
    place = spark.createDataFrame(places, "tree int, feature string, threshold double, word int, bit bigint")
    inner = nodes.where("feature is not null").join(place, ["tree", "feature", "threshold"])
    kid = nodes.select("tree", F.col("node").alias("child"), F.col("cover").alias("child_cover"))
    edges = inner.select("tree", "node", "feature", "word", "bit", "cover", F.inline(F.array(F.struct(F.col("left").alias("child"), F.lit(True).alias("yes")), F.struct(F.col("right").alias("child"), F.lit(False).alias("yes")))))
    edges = durable(edges.join(kid, ["tree", "child"]).select("tree", "node", "child", F.struct("feature", "word", "bit", "yes", (F.col("child_cover") / F.col("cover")).alias("z")).alias("edge")), "edges")
    at = nodes.where("node = 0").select("tree", "node", F.array().cast(f"array<{edges.schema['edge'].dataType.simpleString()}>").alias("way"))
    leaves, ends = None, nodes.where("feature is null").select("tree", "node", (F.col("weight") * F.col("value")).alias("value"))
    while True:
        at = durable(at, "level")
        done = at.join(ends, ["tree", "node"])
        leaves = done if leaves is None else leaves.unionByName(done)
        at = at.join(edges, ["tree", "node"]).select("tree", F.col("child").alias("node"), F.concat("way", F.array("edge")).alias("way"))
        if at.isEmpty():
            break
    step = leaves.select("tree", F.col("node").alias("leaf"), "value", F.explode_outer("way").alias("e"))
    slot = step.groupBy("tree", "leaf", "value", "e.feature").agg(
        F.collect_list(F.when(F.col("e.yes"), F.struct("e.word", "e.bit"))).alias("yes"), F.collect_list(F.when(~F.col("e.yes"), F.struct("e.word", "e.bit"))).alias("no"), F.product("e.z").alias("z"))
    kept = F.filter(F.array_sort(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "yes", "no", "z")))), lambda s: s.isNotNull())
    return slot.groupBy("tree", "leaf", "value").agg(kept.alias("slots"))


def _weights(most: int) -> Column:
    """w[d][s] = s! (d - s - 1)! / d!: the Shapley weight of a set of s among d features."""
    return F.array(*[F.array(*[F.lit(factorial(s) * factorial(d - s - 1) / factorial(d)) for s in range(d)] or [F.lit(0.0)]) for d in range(most + 1)])


def _shares(mask: str, most: int) -> Column:
    """Contribution of every slot of a path under a mask of satisfied slots: value * (satisfied - z) times the weighted sum over the
    sets of other satisfied slots of the cover shares left outside."""
    rest = F.transform(F.sequence(F.lit(0), _one(F.size("slots")) - 1), lambda s: F.aggregate(
        F.transform("slots", lambda x, k: F.when(_bit(s, k) == 0, x["z"]).otherwise(1.0)), F.lit(1.0), lambda a, z: a * z))
    every = F.transform(rest, lambda p, s: F.struct(p.alias("p"), s.alias("s")))

    def share(x, j):
        fits = F.filter(every, lambda e: (_bit(e["s"], j) == 1) & (e["s"].bitwiseAND(F.bitwise_not(F.col(mask).bitwiseOR(_one(j)))) == 0))
        total = F.aggregate(fits, F.lit(0.0), lambda a, e: a + e["p"] * F.get(F.get(_weights(most), F.size("slots")), F.bit_count(e["s"]) - 1))
        held = F.when(_bit(F.col(mask), j) == 1, 1.0).otherwise(0.0)
        return F.struct(x["feature"].alias("feature"), (F.col("value") * (held - x["z"]) * total).alias("shap"))

    return F.transform("slots", share)


def _one(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _bit(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k).bitwiseAND(1)


def attributions(rows: DataFrame, nodes: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, base_value, prediction, and per feature its value and exact contribution: base_value + the sum of a row's contributions
    is its prediction. `keep` identifies a row; rows that agree in it and in all features are one row here."""
    nodes = durable(nodes, "nodes")
    tests = tests_of(nodes)
    leaves = durable(paths(nodes, tests), "paths")
    base, most = leaves.agg(F.sum(F.expr("value * aggregate(slots, 1d, (a, s) -> a * s.z)")), F.max(F.size("slots"))).first()
    outcomes = F.array(*[F.struct(F.lit(t).alias("tree"), _outcome(own).alias("outcome")) for t, own in tests])
    own = rows.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).distinct()
    each = own.select(*keep, *features, F.inline(outcomes))
    kinds = durable(each.select("tree", "outcome").distinct(), "outcomes")
    is_set = lambda tests, want: F.forall(tests, lambda t: F.get("outcome", t["word"]).bitwiseAND(t["bit"]) == (t["bit"] if want else F.lit(0)))
    bits = F.transform("slots", lambda s, k: F.when(is_set(s["yes"], True) & is_set(s["no"], False), _one(k)).otherwise(0))
    held = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    met = kinds.join(leaves, "tree").select("tree", "outcome", "leaf", held.alias("mask"), F.size("slots").alias("d"), "value")
    met = durable(met, "masks")
    masks = met.select("tree", "leaf", "mask").distinct().join(leaves, ["tree", "leaf"]).select("tree", "leaf", "mask", _shares("mask", most or 0).alias("shares"))
    full = F.col("mask") == _one(F.col("d")) - 1
    part = met.join(masks, ["tree", "leaf", "mask"])
    added = part.select("tree", "outcome", F.explode("shares").alias("s")).groupBy("tree", "outcome", "s.feature").agg(F.sum("s.shap").alias("shap"))
    by = added.groupBy("tree", "outcome").agg(F.map_from_entries(F.collect_list(F.struct("feature", "shap"))).alias("by"))
    score = met.groupBy("tree", "outcome").agg(F.sum(F.when(full, F.col("value"))).alias("score"))
    table = durable(score.join(by, ["tree", "outcome"], "left"), "outcome-shares")
    summed = each.join(table, ["tree", "outcome"]).groupBy(*keep, *features).agg(
        F.sum("score").alias("prediction"), *[F.sum(F.coalesce(F.try_element_at("by", F.lit(c)), F.lit(0.0))).alias(f"_shap_{i}") for i, c in enumerate(features)])
    long = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("feature_value"), F.col(f"_shap_{i}").alias("shap")) for i, c in enumerate(features)]
    return summed.select(*keep, F.lit(base).alias("base_value"), "prediction", F.inline(F.array(*long)))
