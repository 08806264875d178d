"""Edge cases on inline rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import decision, fusion, history, lookup, metrics, ordered, profile, proximity, splits, uncertainty, weather

D = dt.date


def readings(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, entity_id string, ts date, value double")


def by_row(df, *cols):
    return {r["row_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_duplicate_date(spark):
    r = readings(spark, [("A", D(2001, 1, 1), 10.0), ("A", D(2001, 6, 1), 20.0), ("A", D(2001, 6, 1), 30.0), ("A", D(2002, 6, 1), 40.0), ("B", D(2001, 1, 1), 5.0)])
    h = by_row(history.history_features(r), "prev_value", "prior_count", "roll3_mean", "prev_change", "long_gap", "density")
    assert h[1][:2] == h[2][:2] == (10.0, 1)
    assert h[3][:4] == (25.0, 3, 17.5, 15.0)
    assert h[4] == (None, 0, None, None, 0, 0.0)
    assert by_row(history.delta_target(history.history_features(r)), "delta")[4] == (None,)


def test_gap_edges_and_interval(spark):
    d0 = D(2001, 1, 1)
    r = readings(spark, [x for k, g in enumerate((1, 730, 731, 1095, 1096)) for x in ((f"E{k}", d0, 1.0), (f"E{k}", d0 + dt.timedelta(g), 2.0))])
    h = by_row(history.history_features(r), "long_gap", "very_long_gap")
    assert [h[2 * k + 1] for k in range(5)] == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 1)]
    days = spark.createDataFrame([(d0 + dt.timedelta(i), 1.0) for i in range(1200)], "ts date, precip double")
    p = by_row(weather.interval_sum_between_readings(weather.previous_date(r), days), "precip_interval")
    assert [p[2 * k + 1][0] for k in range(5)] == [0.0, 729.0, 730.0, 1094.0, 1095.0] and p[0] == (None,)


def test_density_three_calendar_years(spark):
    r = readings(spark, [("A", D(2000, 5, 10), 1.0), ("A", D(2003, 5, 10), 2.0), ("B", D(2000, 5, 9), 1.0), ("B", D(2003, 5, 10), 2.0)])
    h = by_row(history.history_features(r), "density")
    assert h[1][0] == pytest.approx(1 / 3) and h[3][0] == 0.0


def test_dry_streak(spark):
    vals = [0.0, 0.99, 1.0, 0.0, None, 0.0]
    d = spark.createDataFrame([(D(2001, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(vals)], "ts date, precip double")
    assert [r.dry_spell_days for r in weather.dry_spell_streak(d).orderBy("ts").collect()] == [1, 2, 0, 1, 0, 1]


def test_zero_variance(spark):
    d = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y_true double, y_pred double")
    r = metrics.regression_metrics(d).first()
    assert r["r2"] is None and r["pearson"] == 0.0


def test_conformal_ranks(spark):
    s = spark.range(1, 409).select(F.col("id").cast("double").alias("s"))
    assert uncertainty.conformal_cutoff(s, "s", {"q": .1}, rule="upper").first()["q"] == 370
    assert uncertainty.conformal_cutoff(s, "s", {"q": .1}).first()["q"] == 369


def test_weights_and_observability(spark):
    d = spark.createDataFrame([(0, None, 1.0), (3, 1095.0, 1.0)], "prior_count int, gap_days double, climate_available double").withColumns(
        {c: F.lit(1.0) for c in ("lat", "lon", "elev")})
    w = fusion.adaptive_weights_v2(fusion.observability_v2(d), {"a": 1.0, "b": 1.0, "c": 1.0}).collect()
    assert [round(w[0][f"w_{b}"], 6) for b in "abcd"] == [0.047619, 0.47619, 0.47619, 0.0]
    assert round(w[1]["avail_a"], 4) == 0.5249


def test_index_balanced(spark):
    cols = decision.MOISTURE_INPUTS + decision.DEMAND_INPUTS
    ref = spark.createDataFrame([tuple([0.0] * 8), tuple([10.0] * 8)], ", ".join(f"{c} double" for c in cols))
    d = spark.createDataFrame([tuple([4.0] * 8)], ref.schema)
    assert decision.potential_index(d, ref).first()["rrpi"] == 50.0


def test_latest_snapshot_skips_nulls(spark):
    d = spark.createDataFrame([(1, "A", D(2001, 1, 1), 7.0), (2, "A", D(2002, 1, 1), None)], "row_id long, entity_id string, ts date, x double")
    assert profile.latest_snapshot(d, ["x"]).first()["x"] == 7.0


def test_anti_join_nulls_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    b = spark.createDataFrame([(1, None)], "k int, s string")
    assert [r.k for r in lookup.anti_join_rows(a, b, ["k", "s"]).collect()] == [2]


def test_gates_reject_banned():
    from gaugeline.sources import readers

    class Frame:
        columns = ["a", "Raster_Value"]
    with pytest.raises(ValueError):
        readers.reject_banned(Frame())
    with pytest.raises(ValueError):
        readers.require_columns(Frame(), ["b"])


def test_clean_float(spark):
    d = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("Infinity",)], "s string")
    assert [r[0] for r in d.select(S.clean_float("s", 9.0)).collect()] == [1.5, 9.0, 9.0, 9.0, 9.0]


def _hot(spark, n=30000):
    """A third of all rows under one key, many ties, a heavy tail."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 7 == 0, 5.0).otherwise(F.pow(F.col("id") % 997, F.lit(3.0))).alias("v"), F.col("id").alias("row_id"))


def test_quantiles_equal_builtin(spark):
    d = _hot(spark).withColumn("k", F.when(F.col("k") != "k7", F.col("k")))          # a null group too
    probs = {"a": 0.0, "b": .1, "c": .5, "d": .933, "e": 1.0}
    got = {r.k: r for r in ordered.quantiles(d, "v", probs, ["k"]).collect()}
    want = d.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        for n in probs:
            assert got[r.k][n] == pytest.approx(r[n])


def test_average_rank_equals_window(spark):
    d = _hot(spark, 9000).withColumn("k", F.when(F.col("k") != "k7", F.col("k"))).withColumn("v", F.when(F.col("row_id") % 11 != 0, F.col("v")))
    a = {r.row_id: r.rk for r in ordered.average_rank(d, "v", "rk", ["k"]).collect()}
    w = "over (partition by k, v is null order by v)"
    b = {r.row_id: r.rk for r in d.selectExpr("row_id", f"case when v is not null then rank() {w} + (count(*) over (partition by k, v) - 1) / 2 end as rk").collect()}
    assert a == b


def test_order_statistics_edge_cases(spark):
    """Null group, NaN as missing, ties, one-row groups, ranks outside the group, no rows."""
    nan = float("nan")
    rows = [(None, 1.0), (None, 3.0), (None, nan), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", None), ("c", nan), ("d", -1e300), ("d", 1e300), ("d", 0.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in ordered.quantiles(d, "v", {"lo": 0.0, "mid": .5, "hi": 1.0}, ["k"]).collect()}
    assert got == {None: (1.0, 2.0, 3.0), "a": (2.0, 2.0, 2.0), "b": (5.0, 5.0, 5.0), "d": (-1e300, 0.0, 1e300)}
    at = {r.k: (r.n, r.x, r.y) for r in ordered.value_at_rank(d, "v", {"x": "n", "y": "n + 1"}, ["k"]).collect()}
    assert at == {None: (2, 3.0, None), "a": (1, 2.0, None), "b": (2, 5.0, None), "d": (3, 1e300, None)}
    assert ordered.quantiles(d.limit(0), "v", {"m": .5}, ["k"]).collect() == [] and ordered.quantiles(d.limit(0), "v", {"m": .5}).first()["m"] is None
    near = spark.range(1000).selectExpr("1 + id * 1e-12d as v")             # many values in one bucket
    assert ordered.quantiles(near, "v", {"m": .25}).first()["m"] == near.selectExpr("percentile(v, 0.25)").first()[0]


def test_row_lags_keep_null_keys(spark):
    rows = [(i, None if i % 3 == 0 else "e", D(2001, 1, 1) + dt.timedelta(i % 7) if i % 5 else None, float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "row_id bigint, entity_id string, ts date, value double")
    got = history.row_lag_features(d)
    assert got.count() == 60
    seen, want = {}, {}
    for i, e, t, v in sorted(rows, key=lambda r: (str(r[1]), r[2] is not None, r[2] or D(1, 1, 1), r[0])):
        p = seen.setdefault(e, [])
        want[i] = (p[-1] if p else None, len(p))
        p.append(v)
    assert {r.row_id: (r.lag1, r.prior_rows) for r in got.collect()} == want


def test_row_lags_hot_day(spark, monkeypatch):
    """One entity and one day hold a third of the rows."""
    rnd = random.Random(3)
    rows = [("H", D(2001, 1, 1), float(rnd.randrange(50))) for _ in range(700)] + [
        (f"E{rnd.randrange(20)}", D(2001, 1, 1) + dt.timedelta(rnd.randrange(90)), float(rnd.randrange(50))) for _ in range(1400)]
    r = readings(spark, rows)
    cols = ("lag1", "lag2", "gap_days", "prior_rows", "roll3_rows_mean")
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 100)
    a = by_row(history.row_lag_features(r), *cols)
    seen, want = {}, {}
    for i, (e, d, v) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], x[0])):
        p = seen.setdefault(e, [])
        want[i] = (p[-1][1] if p else None, p[-2][1] if len(p) > 1 else None, float((d - p[-1][0]).days) if p else None, len(p),
                   sum(x[1] for x in p[-3:]) / len(p[-3:]) if p else None)
        p.append((d, v))
    assert set(a) == set(want)
    for i, w in want.items():
        assert a[i] == pytest.approx(w)


def test_segments_of_one_entity_with_spread_ids(spark, monkeypatch):
    """Ids far apart on thirty days: ranges of counted size, not one per row."""
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 500)
    d = spark.range(5000).selectExpr("xxhash64(id) as row_id", "'e' as entity_id", "date_add(date'2001-01-01', cast(id % 30 as int)) as ts", "id * 1d as value")
    cut = ordered.counted_segments(d, ["entity_id", "ts", "row_id"], "s").groupBy("s").agg(F.count("*").alias("n"), F.min(F.struct("ts", "row_id")).alias("a"), F.max(F.struct("ts", "row_id")).alias("b")).orderBy("s").collect()
    assert 5 <= len(cut) <= 10 and max(r.n for r in cut) < 1500 and sum(r.n for r in cut) == 5000 and all(x.b < y.a for x, y in zip(cut, cut[1:]))
    got = history.row_lag_features(d).select("row_id", "prior_rows", "lag1").collect()
    order = sorted(got, key=lambda r: r.prior_rows)
    value = {r.row_id: r.value for r in d.collect()}
    assert [r.prior_rows for r in order] == list(range(5000)) and all(y.lag1 == value[x.row_id] for x, y in zip(order, order[1:]))


def test_coarse_buckets_keep_the_order(spark):
    rnd = random.Random(4)
    vs = sorted({0.0, -0.0, 1.0, 2.0, -2.0, 1e-45, -1e-45, 3.4e38, -3.4e38, float("inf"), float("-inf"), *(s * 2.0 ** e * (1 + k / 16) for s in (1, -1) for e in range(-149, 128, 9) for k in (0, 1, 15)), *(rnd.gauss(0, 10 ** rnd.randrange(-30, 30)) for _ in range(500))})
    g = [r.g for r in spark.createDataFrame([(v,) for v in vs], "v double").coalesce(1).select(F.col("v"), ordered._coarse(F.col("v").cast("float")).alias("g")).orderBy("v").collect()]
    assert g == sorted(g) and None not in g
    d = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vs)], "v double, k int")
    for keys in ([], ["k"]):
        for r in ordered.value_at_rank(d, "v", {f"r{i}": str(i) for i in (1, 50, 150, 200)}, keys).collect():
            own = [v for i, v in enumerate(vs) if not keys or i % 3 == r.k]
            assert [r[f"r{i}"] for i in (1, 50, 150, 200)] == [own[i - 1] if i <= len(own) else None for i in (1, 50, 150, 200)]


def _hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("exclude", [True, False])
def test_nearest_brute_force(spark, exclude):
    """Clusters, a far outlier, both sides of the date line, and two sites at one point."""
    rnd = random.Random(5)
    pts = [(40 + rnd.gauss(0, .01), -99 + rnd.gauss(0, .01)) for _ in range(60)] + [(rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for _ in range(30)]
    pts += [(10.0, 179.9), (10.0, -179.9), (-85.0, 3.0), pts[0]]
    t = list(enumerate(pts))
    q, tgt = t, t if exclude else [x for x in t if x[0] % 2]
    q = t if exclude else [x for x in t if not x[0] % 2]
    mk = lambda rows: spark.createDataFrame([(i, *p) for i, p in rows], "entity_id long, lat double, lon double")
    got = {r.entity_id: r.nearest_km for r in proximity.nearest_km(mk(q), mk(tgt), exclude_same=exclude).collect()}
    for i, p in q:
        assert got[i] == pytest.approx(min(_hav(p, o) for j, o in tgt if j != i or not exclude), abs=1e-6)
    if exclude:
        assert got[0] == 0.0


def test_split_has_no_overlap_and_exact_size(spark):
    d = spark.range(1003).select(F.col("id").alias("entity_id"))
    s = splits.split_repeated(d, [1, 2]).groupBy("seed", "split").count().collect()
    n = {(r["seed"], r["split"]): r["count"] for r in s}
    assert n[(1, "test")] == 201 and n[(1, "calibration")] == 161 and sum(v for k, v in n.items() if k[0] == 1) == 1003


def test_stream_drops_late_rows(spark, tmp_path):
    """A row older than the watermark does not change a closed day."""
    from gaugeline.streaming import jobs
    ddl = "event_id long, ts timestamp, user_id long, value double"
    src = str(tmp_path / "in")
    for k, rows in enumerate([[(1, "2024-01-01 10:00:00", 1, 1.0)], [(2, "2024-01-10 10:00:00", 1, 2.0)], [(5, "2024-01-11 10:00:00", 1, 5.0)], [(3, "2024-01-01 11:00:00", 1, 9.0)], [(4, "2024-01-20 10:00:00", 1, 4.0)]]):
        d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.mode("append").parquet(src)
        import time
        time.sleep(1.1)
    q = jobs.table_sink(jobs.daily_rollup(jobs.file_stream(spark, src, ddl)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {r.day: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {D(2024, 1, 1): (1, 1.0), D(2024, 1, 10): (1, 2.0), D(2024, 1, 11): (1, 5.0)}
