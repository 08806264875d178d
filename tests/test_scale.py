"""Steps that must grow no faster than their input, on rows made here."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import clusters as K
from gaugeline.operators import resample as B
from gaugeline.operators import studies as ST
from gaugeline.operators.learn import make_learner
from gaugeline.plans import q_learn as Q
from gaugeline.plans.roles import Tables


def _tables(spark, n=60):
    t = Tables(spark, "nowhere")
    t.readings = spark.range(n).selectExpr("id as row_id", "id % 7 as entity_id", "date_add(date'1997-01-01', cast(id * 11 as int)) as ts", "1997 as yr", "cast(100 + id % 13 as double) as value", "'x' as season")
    return t


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests_are_md5():
    for lo, hi in ((0, 1200), (99_990, 100_020)):
        want = np.frombuffer(b"".join(hashlib.md5(b"42_7_%d" % k).digest() for k in range(lo, hi)), ">u4").reshape(-1, 4).T
        assert (B.digests("42_7_", lo, hi) == want).all()


def test_replicates_over_several_chunks_and_ranges(spark, monkeypatch):
    """Sums of drawn clusters, group by group, against one loop over the draws; null statistics count as missing."""
    monkeypatch.setattr(B, "CHUNK", 16)
    monkeypatch.setattr(B, "RANGE", 32)
    sizes, reps = {"a": 70, "b": 70, "c": 5}, 10
    rows = [(g, p + 1, n, p + 1, float(p), None if p % 3 else 1.0, 2.0 * p, 0.5) for g, n in sizes.items() for p in range(n)]
    stats = spark.createDataFrame(rows, "g string, hash_rank bigint, n_keys bigint, n bigint, sse_base double, sse_cand double, sae_base double, sae_cand double")
    got = {(r.g, r.replicate): (r.n, r.sse_base, r.sse_cand) for r in B.replicate_sums(stats, reps, ["g"], 42).collect()}
    want = {}
    for g, n in sizes.items():
        for b in range(3):
            for k in range(n):
                h = hashlib.md5(f"42_{b}_{k}".encode()).hexdigest()
                for i in range(4):
                    if (r := 4 * b + i + 1) <= reps:
                        p, old = int(h[8 * i:8 * i + 8], 16) % n, want.get((g, r), (0, 0.0, None))
                        want[g, r] = (old[0] + p + 1, old[1] + p, old[2] if p % 3 else (old[2] or 0.0) + 1)
    assert got == want


def test_exploded_logs_are_not_broadcast(spark):
    """Spark sizes exploded rows as the rows before, so a small table of readings became a huge broadcast."""
    t = _tables(spark)
    p, h = t.predictions, t.readings.select("row_id", "season")
    pair = p.where("model = 'm1'").join(p.where("model = 'm2'").select("row_id", F.col("y_pred").alias("other")), "row_id")
    for d in (pair, t.seeded_log.join(h, "row_id")):
        assert "BroadcastHashJoin" not in _plan(d) and "SortMergeJoin" in _plan(d)


def test_seeded_keeps_columns_of_repeated_and_null_rows(spark):
    t = _tables(spark, 6)
    t.readings = t.readings.unionByName(t.readings.where("row_id < 2")).unionByName(t.readings.where("row_id = 5").withColumn("row_id", F.lit(None).cast("bigint")))
    h = t.readings.selectExpr("row_id", "case when row_id > 2 then 'warm' else 'cold' end as cohort")
    cols = ["seed", "config", "row_id", "cohort", "y_pred"]
    old = sorted(map(tuple, t.seeded_log.join(h, "row_id").select(cols).collect()))
    assert sorted(map(tuple, t.seeded(t.readings.join(h, "row_id"), "cohort").select(cols).collect())) == old and len(old) == 15 * 12


def test_kmeans_sums_take_ties_to_the_lower_cluster(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 10, 0), (3, 5, 0), (4, -7, 3)], "k bigint, _z0 bigint, _z1 bigint").repartition(3)
    got = {tuple(r) for r in K._sums(points, 2, [[(0, 0), (10, 0)], [(5, 0)], [(100, 100), (5, 0)]]).collect()}
    assert got == {(0, 0, 3, 0 + 25 + 58, -2, 3), (0, 1, 1, 0, 10, 0), (1, 0, 4, 25 + 25 + 0 + 153, 8, 3), (2, 1, 4, 203, 8, 3)}


def test_folds_fit_each_model_once(spark, monkeypatch):
    """One fit a fold, set and learner, one median pass a fold; rows are predicted by models that never saw their fold."""
    fits, fills = [], []
    monkeypatch.setattr(ST, "make_learner", lambda *a, **kw: fits.append(a) or make_learner(*a, **kw))
    fit = ST.Imputer.fit
    monkeypatch.setattr(ST.Imputer, "fit", lambda self, d: fills.append(1) or fit(self, d))
    rows = [(i, i % 3, float(i % 11), None if i % 7 == 0 else float(i % 5), 2.0 * (i % 11) + 100.0 * (i % 3)) for i in range(330)]
    d = spark.createDataFrame(rows, "row_id bigint, fold int, a double, b double, y double")
    got = ST.fold_log(d, "fold", 3, {"A": ["a"], "B": ["a", "b"]}, "y", {"linear": {}, "forest": {"trees": 2, "depth": 2}}, ["row_id"]).collect()
    assert len(fits) == 12 and len(fills) == 3 and len(got) == 330 * 4
    for r in got:
        if r.learner == "linear" and r.feature_set == "A":
            assert abs(r.y_pred - (2 * (r.row_id % 11) + sum(100 * k for k in range(3) if k != r.fold) / 2)) < 0.1


def test_folds_need_rows(spark):
    d = spark.createDataFrame([(i, i % 2, float(i), float(i)) for i in range(20)], "row_id bigint, fold int, a double, y double")
    with pytest.raises(ValueError):
        ST.fold_log(d, "fold", 3, {"A": ["a"]}, "y", {"linear": {}}, ["row_id"])


def test_ordered_files_keep_order_and_few_batches(spark):
    """Two million rows a file; a range of the order in each, none in two."""
    rows = spark.range(3_000_000).selectExpr("id", "(id * 7919) % 3000000 as at")
    path = Q._ordered_files(Tables(spark, "nowhere"), rows, "at", "many")
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("a").collect()
    assert len(per) <= 8 and sum(r.n for r in per) == 3_000_000
    assert all(x.b < y.a for x, y in zip(per, per[1:]))
