"""Fits over many columns: exact quantiles without a shuffle of values, fills taken once, sums of products of rows held out alike."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import decision, gates, learn, ordered, profile, studies
from gaugeline.plans import catalog, q_decision, q_fusion, q_models
from gaugeline.plans.roles import Tables

PROBS = {"m": .5, "lo": .33, "q3": .75}


def test_column_quantiles_equal_quantiles(spark):
    rnd = random.Random(7)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), None]
    rows = [(rnd.choice(odd) if i % 5 == 0 else rnd.gauss(0, 1), float(i % 3), None, 40.35 + (i % 97) * 3.4e-3, i % 7 if i % 2 else None, rnd.uniform(-1, 1) * 10 ** rnd.randint(-200, 200)) for i in range(1501)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, e bigint, f double").repartition(5)
    got = ordered.column_quantiles(d, dict.fromkeys("abcdef", PROBS))
    for c in "abcdef":
        want = ordered.quantiles(d, c, PROBS).first().asDict()
        for p in PROBS:
            x, y = got[c][p], want[p]
            assert x == y or (math.isnan(x) and math.isnan(y)), (c, p, x, y)
    assert got["c"] == dict.fromkeys(PROBS) and set(ordered.column_quantiles(d.where("false"), {"a": PROBS})["a"].values()) == {None}


def test_column_quantiles_shuffle_no_values(spark, monkeypatch):
    """What leaves the tasks goes with columns, ranks and cells, not with the rows."""
    seen, count = [], ordered._digit_counts
    monkeypatch.setattr(ordered, "_digit_counts", lambda *a: seen.append(count(*a)) or seen[-1])
    got = ordered.column_quantiles(spark.range(200_000).selectExpr("sqrt(id) as x"), {"x": {"m": .5}})
    lo, hi = sorted(math.sqrt(i) for i in range(200_000))[99_999:100_001]
    assert got["x"]["m"] == pytest.approx((lo + hi) / 2, rel=1e-15) and len(seen) == len(ordered.DIGITS)
    assert max(s.count() for s in seen) <= 2 * (1 << max(ordered.DIGITS)) and seen[-1].agg(F.sum("n")).first()[0] < 10


def test_fills_are_taken_once_a_regime_and_where_needed(spark, monkeypatch):
    asked, real = [], learn.medians
    monkeypatch.setattr(learn, "medians", lambda d, cols: asked.append(list(cols)) or real(d, cols))
    rows = [(i, float(i % 11), None if i % 4 == 1 else float(i % 5), float(i % 3), 3.0 * (i % 11) + i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, y double")
    train, test = d.where("row_id < 200"), d.where("row_id >= 200").withColumn("c", F.when(F.col("row_id") > 210, F.col("c")))
    sets = {"A": ["a"], "B": ["a", "b"], "C": ["a", "b", "c"]}
    got = {(r.feature_set, r.row_id): r.y_pred for r in learn.study({"t": (train, test)}, sets, ["linear"], "y", ["row_id"]).collect()}
    assert asked == [["b", "c"]]
    for name, own in sets.items():
        f = learn.fit(train, own, "y", "linear")                # the medians of all features
        want = {r.row_id: r.y_pred for r in f.predict(test).collect()}
        assert all(abs(got[name, k] - y) < 1e-9 for k, y in want.items()) and len(want) == 100


def test_cross_products_of_rows_held_out_alike(spark, monkeypatch):
    """Against one sum a split; infinite values stay in the splits that train on them."""
    monkeypatch.setattr(studies, "ALIKE", 2)
    rnd = random.Random(3)
    rows = [([s for s in (1, 2, 3) if rnd.random() < .3] if i else [1], float("inf") if not i else rnd.gauss(0, 1) if i % 6 else None, rnd.gauss(5, 1)) for i in range(400)]
    d = spark.createDataFrame(rows, "held array<int>, x double, y double").repartition(3)
    got = {(r.split, r.cell): r.value for r in studies.cross_products(d, [1, 2, 3, 4], ["x"], "y").collect()}
    for s in (1, 2, 3, 4):
        z = np.array([(1.0, x or 0.0, x is None, y) for held, x, y in rows if s not in held], float)
        with np.errstate(invalid="ignore"):
            want = (z.T @ z).ravel()
        assert np.allclose([got[s, k] for k in range(16)], want, equal_nan=True)
    assert all(math.isfinite(got[1, k]) for k in range(16))


def test_predictions_are_compiled(spark):
    """No lambda over the feature array: those are interpreted, row by row."""
    d = spark.createDataFrame([(1, [0], 1.0, None, 2.0)], "row_id int, held array<int>, a double, b double, y double")
    models = spark.createDataFrame([(0, "A", 1.0, [2.0, 3.0], [0.0, 5.0])], "split int, feature_set string, intercept double, beta array<double>, fill array<double>")
    log = studies.linear_log(d, models, {"A": ["a", "b"]}, "y", ["row_id"])
    assert log.first()["y_pred"] == 18.0 and "lambdafunction" not in log._jdf.queryExecution().executedPlan().toString()


def test_partition_gates_count_entities(spark):
    g = lambda rows: {r.gate: r.violations for r in gates.partition_gates(spark.createDataFrame(rows, "entity_id int, split string")).collect()}
    assert g([(1, "train"), (2, "calibration"), (3, "test")]) == {"calibration_test_disjoint": 0, "parts_filled": 0}
    assert g([(1, "train"), (2, "calibration"), (2, "test"), (None, "train")]) == {"calibration_test_disjoint": 1, "parts_filled": 0}
    assert g([(None, "train"), (2, "test")]) == {"calibration_test_disjoint": 0, "parts_filled": 2}


def test_long_plans_are_run_once(spark):
    """Scored rows and daily claims are read twice; what makes them is run once."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    scored = spark.range(60).selectExpr("'S' as scenario", "cast(id % 3 as string) as depth_class", "id as prior_count", "cast(id as double) as predicted_delta")
    got = decision.scenario_summary(scored.mapInArrow(seen, scored.schema)).collect()
    assert sum(r.n for r in got) == 59 and calls.value == 60
    days = spark.range(60).selectExpr("id % 3 as entity_id", "date_add(date'2000-01-01', cast(id as int)) as ts", "cast(id as double) as value", "case when id > 2 then id - 3d end as prev_value", "case when id > 5 then id - 6d end as prev2_value", "case when id > 2 then 3d end as gap_days")
    out = gates.second_lag_gates(days.mapInArrow(seen, days.schema), days).collect()
    assert [tuple(r) for r in out] == [("second_lag_matches", 0)] and calls.value == 120


def _folder(spark, path):
    """Five hundred readings of forty sites, five years of weather."""
    put = lambda d, name: d.write.parquet(f"{path}/{name}.parquet")
    put(spark.range(500).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "case when id % 5 = 0 then 'P' else 'F' end as o_orderstatus", "1e3d * (100 + id % 37) as o_totalprice", "timestamp(date_add(date'1996-01-01', cast(id * 4 as int))) as o_orderdate", "'1-URGENT' as o_orderpriority"), "orders")
    put(spark.range(40).selectExpr("id as c_custkey", "id % 3 as c_nationkey", "30d * id as c_acctbal"), "customer")
    put(spark.range(3).selectExpr("id as n_nationkey", "concat('N', id) as n_name"), "nation")
    put(spark.range(2200).selectExpr("id as l_orderkey", "id % 7 as l_linenumber", "timestamp(date_add(date'1995-06-01', cast(id as int))) as l_shipdate", "cast(id % 50 as double) as l_quantity", "1e3d * (id % 90) as l_extendedprice", "(id % 11) / 100d as l_discount", "(id % 9) / 100d as l_tax"), "lineitem")
    return str(path)


def test_fused_table_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Each configuration goes straight to its folder; all have the same columns."""
    plans, write = [], q_fusion.R.write_table
    monkeypatch.setattr(q_fusion.R, "write_table", lambda d, *a, **kw: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d, *a, **kw))
    got = {r.config: r for r in catalog.QUERIES["write_fused_configs"](spark, _folder(spark, tmp_path)).collect()}
    assert sorted(got) == sorted(q_fusion.CONFIGS) and len({r.n for r in got.values()}) == 1
    assert got["A0"].mean_w_b is None and got["C2"].mean_w_b is not None
    assert plans and not any(x in p for p in plans for x in ("Rebalance", "Union", "Join", "Window"))


def test_latest_rows_are_not_joined_by_row_id(spark, tmp_path):
    """The latest row of each site, with the prediction of its own reading."""
    t = Tables(spark, _folder(spark, tmp_path))
    d = q_decision._latest(t)
    old = t.response.join(t.predictions.where("model = 'm1'").select("row_id", "y_pred"), "row_id").withColumn("predicted_delta", F.col("prev_value") - F.col("y_pred"))
    cols = ["entity_id", *q_decision.LATEST_COLS]
    rows = lambda x: sorted(map(str, x.select(cols).collect()))
    assert rows(d) == rows(profile.latest_snapshot(old, q_decision.LATEST_COLS)) and "row_id#" not in "".join(x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_held_out_responses_are_written_once(spark, tmp_path, monkeypatch):
    """The rows of the response study are written with the splits that hold them out, not before and again."""
    names, write = [], q_models.durable
    monkeypatch.setattr(q_models, "durable", lambda d, name: names.append(name) or write(d, name))
    got = q_models._response_repeated(Tables(spark, _folder(spark, tmp_path))).collect()
    assert names == ["held", "models"] and {r.seed for r in got} == set(q_models.SEEDS)
