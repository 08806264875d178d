"""The fusion benchmark: every run of its grid, at full size, on rows made here."""

import random

from pyspark.sql import functions as F

from gaugeline.config import BLOCKS
from gaugeline.operators import fusion as U
from gaugeline.operators import learn as L
from gaugeline.plans import q_learn as Q
from gaugeline.plans.registry import QUERIES


def _model_rows(spark, n=120):
    r = random.Random(5)
    cols = [c for b in "abc" for c in BLOCKS[b]]
    rows = [(i, i % 12, 1997 + i % 4, 1.0, r.random() * 100, *[None if i % 12 == 0 and c == "prev_value" else float(r.randrange(50)) for c in cols]) for i in range(n)]
    d = spark.createDataFrame(rows, "row_id bigint, entity_id bigint, yr int, climate_available double, value double, " + ", ".join(f"{c} double" for c in cols))
    return d.withColumn("ts", F.expr("date_add(date'1997-01-01', cast(row_id as int))"))


def test_every_run_of_the_grid(spark, monkeypatch):
    """Five seeds, six configurations, three learners: 400 trees, 500 rounds, and no smaller ones."""
    runs, d = [], _model_rows(spark)

    def scored(train, test, features, target, learner, keep, seed, fills, **kw):
        runs.append((learner, seed, len(features), tuple(sorted(kw.items()))))
        return test.select(*keep, F.col(target).alias("y_true"), F.lit(50.0).alias("y_pred")).withColumns({"error": F.col("y_pred") - F.col("y_true"), "abs_error": F.abs(F.col("y_pred") - F.col("y_true"))})

    monkeypatch.setattr(Q, "_rows", lambda t: d)
    monkeypatch.setattr(L, "train_predict", scored)
    got = QUERIES["fusion_benchmark"](spark, "nowhere").collect()
    assert {(r.seed, r.config, r.learner) for r in got} == {(s, c, m) for s in range(42, 47) for c in ("A0", "A1", "A6", "C0", "C1", "C2") for m in ("linear", "forest", "boosted")}
    assert len(got) == len(runs) == 90 and all(r.n == 30 for r in got)          # three of twelve entities, ten rows each
    forests, boosted = ([dict(r[3]) for r in runs if r[0] == m] for m in ("forest", "boosted"))
    assert all(k["trees"] == 400 and k["depth"] == 30 and k["columns"] == "all" for k in forests)
    assert all((k["rounds"], k["depth"], k["step"], k["rows"], k["columns"], k["least"]) == (500, 6, 0.05, 0.8, "0.8", 2) for k in boosted)
    assert {r[2] for r in runs if r[0] == "forest"} == {U.assemble_features(c)[1]["total"] for c in Q.RUN_CONFIGS}


def test_learners_take_their_sizes(spark):
    f, b = L.make_learner("forest", "y", **Q.FULL["forest"]), L.make_learner("boosted", "y", **Q.FULL["boosted"])
    assert (f.getNumTrees(), f.getMaxDepth(), f.getFeatureSubsetStrategy(), f.getMinInstancesPerNode()) == (400, 30, "all", 1)
    assert (b.getMaxIter(), b.getMaxDepth(), b.getStepSize(), b.getSubsamplingRate(), b.getFeatureSubsetStrategy(), b.getMinInstancesPerNode()) == (500, 6, 0.05, 0.8, "0.8", 2)
    f, b = L.make_learner("forest", "y"), L.make_learner("boosted", "y")
    assert (f.getNumTrees(), f.getMaxDepth(), f.getFeatureSubsetStrategy(), b.getMaxIter(), b.getMaxDepth(), b.getStepSize(), b.getSubsamplingRate(), b.getFeatureSubsetStrategy()) == (20, 5, "auto", 10, 3, 0.1, 1.0, "all")


def test_runs_are_fitted_and_scored(spark):
    """A run per learner; a constant whose deviation is rounding does not spoil the linear one; null features take the training median."""
    r = random.Random(2)
    rows = [(i, a := r.random() * 10, None if i % 9 == 0 else r.random(), 0.8731, None if i % 50 == 0 else 3 * a + r.random()) for i in range(400)]
    d = spark.createDataFrame(rows, "row_id bigint, a double, b double, k double, y double")
    small = {"linear": {}, "forest": {"trees": 5, "depth": 5, "columns": "all"}, "boosted": {"rounds": 12, "depth": 3, "step": 0.4, "rows": 0.8, "columns": "0.8", "least": 2}}
    cells = {(s, "X"): (d.where(F.col("row_id") % 3 != s), d.where(F.col("row_id") % 3 == s), ["a", "b", "k"]) for s in (0, 1)}
    got = L.benchmark(cells, small, "y", ["row_id"]).collect()
    assert {(r.seed, r.config, r.learner) for r in got} == {(s, "X", m) for s in (0, 1) for m in small}
    assert all(r.n == sum(x[0] % 3 == r.seed and x[4] is not None for x in rows) and r.r2 > 0.9 for r in got)
