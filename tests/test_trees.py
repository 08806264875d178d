"""Tree attributions against subset enumeration."""

from __future__ import annotations

import random
from itertools import combinations
from math import factorial

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from gaugeline.operators import trees

FEATURES = [f"x{i}" for i in range(7)]


def by_enumeration(nodes, row, features):
    """(mean of the model, prediction, {feature: Shapley value}) by every subset of features."""
    by = {}
    for n in nodes:
        by.setdefault(n["tree"], {})[n["node"]] = n

    def value(known, tree, node=0):
        n = by[tree][node]
        if n["feature"] is None:
            return n["weight"] * n["value"]
        if n["feature"] in known:
            x = row[n["feature"]]
            return value(known, tree, n["left"] if x is not None and x <= n["threshold"] else n["right"])
        return sum(by[tree][k]["cover"] / n["cover"] * value(known, tree, k) for k in (n["left"], n["right"]))

    total = {s: sum(value(s, t) for t in by) for k in range(len(features) + 1) for s in map(frozenset, combinations(features, k))}
    d, out = len(features), {}
    for f in features:
        others = [c for c in features if c != f]
        out[f] = sum(factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (total[s | {f}] - total[s]) for k in range(d) for s in map(frozenset, combinations(others, k)))
    return total[frozenset()], total[frozenset(features)], out


def check(rows, nodes, got, features):
    for r in rows:
        base, pred, expected = by_enumeration(nodes, r, features)
        own = [g for g in got if g["id"] == r["id"]]
        assert len(own) == len(features)
        for g in own:
            assert abs(g["shap"] - expected[g["feature"]]) < 1e-9 and abs(g["base_value"] - base) < 1e-9 and abs(g["prediction"] - pred) < 1e-9
        assert abs(own[0]["base_value"] + sum(g["shap"] for g in own) - pred) < 1e-9


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_fitted_models(spark, kind):
    r = random.Random(2)
    data = [(i, *[float(r.randrange(12)) for _ in FEATURES]) for i in range(400)]
    df = spark.createDataFrame(data, "id bigint, " + ", ".join(f"{c} double" for c in FEATURES)).withColumn("y", F.expr("x0 * x1 + 5 * x2 + case when x3 > 5 then 20 else x4 end + x5 / 3"))
    v = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    est = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=5, seed=1) if kind == "forest" else GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, seed=1)
    model = est.fit(v)
    nodes = trees.model_nodes(model, FEATURES)
    some = df.where("id < 12")
    got = trees.attributions(some, nodes, FEATURES, ["id"]).collect()
    check([x.asDict() for x in some.collect()], [n.asDict() for n in nodes.collect()], got, FEATURES)
    pred = {x["id"]: x["prediction"] for x in model.transform(v).select("id", "prediction").collect()}
    assert all(abs(pred[g["id"]] - g["prediction"]) < 1e-9 for g in got)


def test_odd_rows_and_trees(spark):
    """A stump, a single leaf, one feature twice on a path, more tests than one integer holds; missing and NaN values, ties on a
    threshold, repeated rows, no rows."""
    nodes = [(0, 1.0, 0, 1, 2, "x0", 3.0, 10.0, 0.0), (0, 1.0, 1, None, None, None, None, 4.0, 5.0), (0, 1.0, 2, 3, 4, "x0", 7.0, 6.0, 0.0), (0, 1.0, 3, None, None, None, None, 1.0, -2.0), (0, 1.0, 4, 5, 6, "x1", 0.5, 5.0, 0.0),
             (0, 1.0, 5, None, None, None, None, 2.0, 8.0), (0, 1.0, 6, None, None, None, None, 3.0, 1.0), (1, 0.5, 0, None, None, None, None, 10.0, 4.0)]
    for i in range(70):                      # a chain of tests
        nodes += [(2, 2.0, 2 * i, 2 * i + 1, 2 * i + 2, "x1", -float(i), 100.0 - i, 0.0), (2, 2.0, 2 * i + 1, None, None, None, None, 1.0, float(i))]
    nodes = [n if n[0] != 2 or n[3] is None else (*n[:3], n[4], n[3], *n[5:]) for n in nodes] + [(2, 2.0, 140, None, None, None, None, 30.0, -1.0)]
    df = spark.createDataFrame(nodes, "tree int, weight double, node int, left int, right int, feature string, threshold double, cover double, value double")
    rows = spark.createDataFrame([(1, 3.0, 0.5), (2, None, 0.2), (3, float("nan"), 9.0), (4, 7.0, None), (5, 5.0, -33.5), (5, 5.0, -33.5), (6, 100.0, -1000.0)], "id bigint, x0 double, x1 double")
    got = trees.attributions(rows, df, ["x0", "x1"], ["id"]).collect()
    plain = {r["id"]: {k: None if v != v else v for k, v in r.asDict().items()} for r in rows.collect()}
    assert len(got) == 2 * len(plain)
    check(list(plain.values()), [n.asDict() for n in df.collect()], got, ["x0", "x1"])
    assert trees.attributions(rows.limit(0), df, ["x0", "x1"], ["id"]).collect() == []
