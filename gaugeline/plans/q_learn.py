"""Model studies (rows-only checks unless closed form) and streaming jobs."""

from itertools import combinations

from pyspark.sql import functions as F

from gaugeline.config import BLOCKS
from gaugeline.operators import decision as D
from gaugeline.operators import fusion as U
from gaugeline.operators import history as H
from gaugeline.operators import learn as L
from gaugeline.operators import metrics as M
from gaugeline.operators import profile as P
from gaugeline.operators import splits as S
from gaugeline.operators import uncertainty as C
from gaugeline.operators import attribution as A
from gaugeline.plans.q_models import FAMILIES
from gaugeline.plans.registry import query
from gaugeline.session import durable, scratch_path
from gaugeline.streaming import jobs as J
from gaugeline.streaming import stateful as K

SPACE = ["lat", "lon", "elev"]
CLIMATE = BLOCKS["b"]
LAGS = ["prev_value", "gap_days", "roll3_mean", "roll3_std", "hist_mean", "prior_count", "density"]
KEEP = ["row_id", "entity_id", "ts"]
MET = ["n", "r2", "mae", "rmse"]


def _rows(t):
    return durable(t.model_rows, "model-rows")


def _temporal(d):
    return d.where("yr <= 1998"), d.where("yr >= 2000")


def _unseen(d, seed=42):
    s = durable(S.split_unseen_entities(d, seed=seed), "unseen")
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def _cohort(d):
    return d.withColumn("cohort", F.when(F.col("prior_count") > 0, "warm").otherwise("cold"))


OLS = ["prev_value", "gap_days", "hist_mean", "density"]


@query("ols_single_feature", " union all ".join(f"select '{c}' as feature, regr_count(value, {c})::bigint as n, regr_slope(value, {c}) as slope, regr_intercept(value, {c}) as intercept, regr_r2(value, {c}) as r2 from hist" for c in OLS), "slope intercept r2")
def _(t):
    return L.ols_single_feature(t.history, OLS, "value")


@query("spatial_clusters")
def _(t):
    c = L.spatial_clusters(t.sites)
    return c.groupBy("cluster").agg(F.count(F.lit(1)).alias("sites"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


@query("spatial_holdout")
def _(t):
    """Leave one cluster out."""
    d = durable(t.model_rows.join(L.spatial_clusters(t.sites).select("entity_id", "cluster"), "entity_id"), "clustered")
    parts = {f"cluster{k}": (d.where(F.col("cluster") != k), d.where(F.col("cluster") == k)) for k in range(5)}
    return L.log_metrics(L.study(parts, {"B": LAGS + SPACE}, ["linear"], "value", KEEP), ["regime", "learner"]).select("regime", "learner", *MET)


@query("train_predict")
def _(t):
    tr, te = _temporal(_rows(t))
    return L.train_predict(tr, te, LAGS + SPACE, "value", "forest", KEEP)


@query("baseline_learners")
def _(t):
    d = _rows(t)
    log = L.study({"temporal": _temporal(d), "unseen": _unseen(d)}, {"spatial": SPACE + ["yr"], "environmental": SPACE + ["yr"] + CLIMATE}, ["linear", "forest", "boosted"], "value", KEEP, rounds=5)
    return L.log_metrics(log, ["regime", "feature_set", "learner"]).select("regime", "feature_set", "learner", *MET)


@query("feature_importance")
def _(t):
    tr, _ = _temporal(_rows(t))
    return L.feature_importance(L.fit(tr, LAGS + SPACE + CLIMATE, "value", "forest"))


@query("feature_set_comparison")
def _(t):
    d = _cohort(_rows(t))
    log = L.study({"temporal": _temporal(d), "unseen": _unseen(d)}, {"A": SPACE + CLIMATE, "B": SPACE + CLIMATE + BLOCKS["a"][:12], "C": SPACE + CLIMATE + BLOCKS["a"]}, ["linear", "boosted"], "value", KEEP + ["cohort"], rounds=5)
    return M.metrics_by_cohort_sets(log, ["regime", "feature_set", "learner"], "cohort").select("regime", "feature_set", "learner", "cohort", *MET)


@query("ablation_study")
def _(t):
    sets = {"A0": SPACE, "A1": SPACE + ["prev_value"], "A2": SPACE + ["prev_value", "gap_days"], "A3": SPACE + ["prev_value", "gap_days", "roll3_mean", "roll3_std"], "A4": SPACE + LAGS}
    return L.log_metrics(L.study({"temporal": _temporal(_rows(t))}, sets, ["linear"], "value", KEEP), ["feature_set", "learner"]).select("feature_set", "learner", *MET)


@query("response_modelling")
def _(t):
    d = durable(t.response.where("delta is not null"), "response")
    robust = P.within_fences(d, "delta", 1.5)
    feats = FAMILIES["S5"]
    log = L.study({"temporal_full": _temporal(d), "temporal_robust": _temporal(robust), "unseen_full": _unseen(d)}, {"R": feats}, ["linear", "forest"], "delta", KEEP, trees=10)
    return L.log_metrics(log, ["regime", "learner"]).select("regime", "learner", *MET)


#: The runs of the fusion benchmark, and its learners at full size: 400 bagged trees without a limit of depth (30 is MLlib's), 500 rounds.
RUN_SEEDS, RUN_CONFIGS = (42, 43, 44, 45, 46), ("A0", "A1", "A6", "C0", "C1", "C2")
FULL = {"linear": {}, "forest": {"trees": 400, "depth": 30, "columns": "all"},
        "boosted": {"rounds": 500, "depth": 6, "step": 0.05, "rows": 0.8, "columns": "0.8", "least": 2}}


@query("fusion_benchmark")
def _(t):
    """Seed x configuration x learner: five splits by entity, six configurations, three learners; the metrics of ninety runs."""
    d, cells = _rows(t), {}
    for seed in RUN_SEEDS:
        tr, te = _unseen(d, seed)
        f = U.FusionFit.fit(tr)
        for cfg in RUN_CONFIGS:
            cells[seed, cfg] = (f.matrix(tr, cfg, KEEP + ["value"]), f.matrix(te, cfg, KEEP + ["value"]), U.assemble_features(cfg)[0])
    return L.benchmark(cells, FULL, "value", KEEP).select("seed", "config", "learner", *MET)


@query("experiment_grid", """select seed::bigint as seed, config, model, (select count(*) from readings) as rows from (select unnest(range(42, 47)) as seed), (select unnest(['A0','C0','C1','C2']) as config), (select unnest(['linear','forest','boosted']) as model)""")
def _(t):
    """The run list of a benchmark with the number of rows each run covers: three short literal lists."""
    n = t.readings.agg(F.count(F.lit(1)).alias("rows"))
    a = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    d = n.withColumn("seed", a([42, 43, 44, 45, 46]))
    return d.withColumn("config", a(["A0", "C0", "C1", "C2"])).withColumn("model", a(["linear", "forest", "boosted"]))


@query("quantile_regressor")
def _(t):
    tr, te = _temporal(_rows(t))
    return L.leaf_quantiles(tr, te, LAGS + SPACE, "value", {"q05": .05, "q50": .5, "q95": .95}, ["row_id"])


@query("cqr_from_forest")
def _(t):
    """Quantile forest, then conformal correction on the validation year; coverage on the later years."""
    d = _rows(t)
    q = durable(L.leaf_quantiles(d.where("yr <= 1998"), d.where("yr >= 1999"), LAGS + SPACE, "value", {"q05": .05, "q50": .5, "q95": .95}, ["row_id", "yr"]), "cqr")
    r = C.cqr_intervals(q.where("yr = 1999"), q.where("yr >= 2000"), [], "q05", "q95").withColumnRenamed("q50", "y_pred")
    return C.interval_metrics(r, [], lower="cqr_lower_90", upper="cqr_upper_90")


@query("attribution_occlusion")
def _(t):
    """Importance by occlusion: what the prediction loses when a feature is set to its training median."""
    tr, te = _temporal(_rows(t))
    f = L.fit(tr, LAGS, "value", "forest", trees=10)
    return A.global_importance(L.occlusion_attribution(f, te, ["row_id"]))


@query("interaction_profile")
def _(t):
    tr, te = _temporal(_rows(t))
    f = L.fit(tr, LAGS, "value", "forest", trees=10)
    return L.interaction_profile(f, te, list(combinations(["prev_value", "gap_days", "roll3_mean", "hist_mean", "density"], 2)))


@query("scenario_scoring")
def _(t):
    d = durable(t.response, "response")
    feats = FAMILIES["S5"]
    ref = d.where("yr <= 1998 and prior_count > 0")
    f = L.fit(ref.where("delta is not null"), feats, "delta", "forest", trees=10)
    latest = P.latest_snapshot(d, feats)
    s = f.predict(D.scenario_inputs(latest, ref, feats)).withColumnRenamed("y_pred", "predicted_delta")
    return D.scenario_summary(s)


@query("observability_fit_sensitivity")
def _(t):
    """A few corners of the observability grid carried through a fit."""
    tr, te = _temporal(_rows(t))
    base = U.FusionFit.fit(tr)
    cols = U.assemble_features("C2")[0]
    out = None
    from dataclasses import replace
    for scale, sat in ((180.0, 2.0), (365.25, 3.0), (730.0, 5.0)):
        f = replace(base, observability=U.Observability(gap_scale=scale, saturation=sat))
        p = L.train_predict(f.matrix(tr, "C2", KEEP + ["value"]), f.matrix(te, "C2", KEEP + ["value"]), cols, "value", "linear", KEEP)
        p = p.withColumns({"scale": F.lit(scale), "saturation": F.lit(sat)})
        out = p if out is None else out.unionByName(p)
    return L.log_metrics(out, ["scale", "saturation"]).select("scale", "saturation", *MET)


# what SQL can state about the fitted models ---------------------------------------------------------------------------

def _flag(c):
    return F.when(c, 1).otherwise(0).cast("bigint")


@query("train_predict_checks", """select count(*) as n, count(*) as finite, 1::bigint as deterministic from model_rows where yr >= 2000""")
def _(t):
    """Every later reading is scored, finitely, and a second fit gives the same scores. (The mapped values are noise, so
    no learner can be expected to beat the mean.)"""
    d = _rows(t)
    tr, te = _temporal(d)
    once, again = (durable(L.train_predict(tr, te, LAGS + SPACE, "value", "forest", KEEP), "scored") for _ in range(2))
    same = once.join(again.select("row_id", F.col("y_pred").alias("again")), "row_id")
    return same.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("y_pred") < 1e300).alias("finite"), _flag(F.max(F.abs(F.col("y_pred") - F.col("again"))) < 1e-9).alias("deterministic"))


@query("quantile_regressor_checks", "select count(*) as n, 0::bigint as crossed from model_rows where yr >= 2000")
def _(t):
    tr, te = _temporal(_rows(t))
    q = L.leaf_quantiles(tr, te, LAGS + SPACE, "value", {"q05": .05, "q50": .5, "q95": .95}, ["row_id"])
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("q05") > F.col("q50") + 1e-9) | (F.col("q50") > F.col("q95") + 1e-9)).alias("crossed"))


@query("feature_importance_checks", f"select {len(LAGS + SPACE + CLIMATE)}::bigint as features, 1e0 as total, 0::bigint as negative", "total")
def _(t):
    tr, _ = _temporal(_rows(t))
    imp = L.feature_importance(L.fit(tr, LAGS + SPACE + CLIMATE, "value", "forest"))
    return imp.agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


@query("spatial_clusters_checks", "select count(*) as sites, 5::bigint as clusters, 0::bigint as misplaced from sites")
def _(t):
    """Every site lies in the cluster of its nearest centre (centres: the means of the clusters, in scaled coordinates)."""
    c = durable(L.spatial_clusters(t.sites), "placed")
    scale = c.agg(F.stddev_samp("lat").alias("sa"), F.stddev_samp("lon").alias("so"))    # one row
    mid = c.groupBy("cluster").agg(F.avg("lat").alias("ma"), F.avg("lon").alias("mo")).withColumnRenamed("cluster", "other")
    far = F.pow((F.col("lat") - F.col("ma")) / F.col("sa"), F.lit(2.0)) + F.pow((F.col("lon") - F.col("mo")) / F.col("so"), F.lit(2.0))
    best = c.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(scale)).groupBy("entity_id", "cluster").agg(F.min(far).alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), far)).alias("own"))   # five centres
    return best.agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("cluster").alias("clusters"), F.count_if(F.col("own") > F.col("least") + 0.05).alias("misplaced"))


@query("two_feature_fit", """with s as (select regr_sxx(value, x) as sxx, regr_syy(value, x) as syy, regr_sxy(value, x) as sxy, avg(value) as my, avg(x) as mx from (select value, coalesce(density, 0) as x from model_rows where yr <= 1998))
       select row_id, my + sxy / sxx * (coalesce(density, 0) - mx) as y_pred from model_rows, s where yr >= 2000""", "y_pred", digits=3)
def _(t):
    """The linear learner with one feature, against the closed form."""
    tr, te = (d.withColumn("density", F.coalesce("density", F.lit(0.0))) for d in _temporal(_rows(t)))
    return L.train_predict(tr, te, ["density"], "value", "linear", ["row_id"]).select("row_id", "y_pred")


@query("study_row_counts", """with s as (select entity_id, row_number() over (order by md5(entity_id::varchar || '_42'), entity_id) <= ceil(0.2 * count(*) over ()) as test from (select distinct entity_id from readings)),
       n as (select 'temporal' as regime, count(*) as n from model_rows where yr >= 2000 union all select 'unseen', count(*) from model_rows m join s using (entity_id) where s.test)
       select regime, f.feature_set, n.n from n, (select unnest(['A', 'B']) as feature_set) f""")
def _(t):
    """Every regime and feature set scores exactly the rows of its test part."""
    d = _rows(t)
    log = L.study({"temporal": _temporal(d), "unseen": _unseen(d)}, {"A": SPACE + CLIMATE, "B": SPACE + CLIMATE + LAGS}, ["linear"], "value", KEEP)
    return log.groupBy("regime", "feature_set").agg(F.count("y_pred").alias("n"))


# streaming ------------------------------------------------------------------------------------------------------------

EV_DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


ROWS_PER_FILE = 2_000_000       # a micro-batch has costs of its own, whatever its rows


def _event_files(t, order_key: str, repeat: bool = False):
    """The events table as a folder of files, each one micro-batch, seven at least; with `repeat` a share of rows is
    delivered twice."""
    path = scratch_path(t.spark, "events")
    e = t.raw("events")
    files = 7 + e.count() // ROWS_PER_FILE
    if repeat:
        e = e.unionByName(e.where("event_id % 10 = 3"))
    e.withColumn("part", F.expr(order_key)).repartitionByRange(files, "part").drop("part").write.parquet(path)
    return path


def _ordered_files(t, rows, order: str, name: str, least: int = 7):
    """A table as a folder of files that arrive one after the other, each holding a range of `order`: as many micro-batches."""
    path, files = scratch_path(t.spark, name), least + rows.count() // ROWS_PER_FILE
    ranges = scratch_path(t.spark, name)
    rows.repartitionByRange(files, order).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(ranges)     # a part is read once
    parts = t.spark.read.schema(rows.withColumn("_part", F.lit(0)).schema).parquet(ranges)
    for i in range(files):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path


def _drain(q):
    q.awaitTermination()


@query("stream_ingest_readings", "select event_id, ts, user_id, value from events where user_id is not null and value is not null", "value")
def _(t):
    """Files hold ranges of event time and come one a micro-batch, a tenth of the rows twice, so state is kept across batches: two days
    of keys are all that the de-duplication remembers."""
    e = t.raw("events")
    src, out, ck = _ordered_files(t, e.unionByName(e.where("event_id % 10 = 3")), "ts", "events"), scratch_path(t.spark, "ingested"), scratch_path(t.spark, "ck")
    _drain(J.append_sink(J.ingest_readings(J.file_stream(t.spark, src, EV_DDL), delay="2 days"), out, ck))
    return t.spark.read.parquet(out).select("event_id", "ts", "user_id", "value")


@query("stream_latest_state", """select user_id, arg_max(value, (ts, event_id)) as latest_value, max(ts) as latest_ts, count(*) as n, case when max(ts) < timestamp '2024-01-30' - interval 1 day then 1::bigint else 0::bigint end as stale from events group by user_id""", "latest_value")
def _(t):
    src, out, ck = _event_files(t, "event_id % 7"), scratch_path(t.spark, "latest"), scratch_path(t.spark, "ck")
    _drain(J.state_sink(J.latest_state(J.file_stream(t.spark, src, EV_DDL, files_per_trigger=4)), out, ck))
    s = J.with_staleness(J.merged(t.spark, out, ["user_id"]), F.lit("2024-01-30").cast("timestamp"), 1.0)
    return s.select("user_id", "latest_value", "latest_ts", "n", "stale")


@query("stream_daily_rollup", """select cast(ts as date) as day, count(*) as n, sum(value) as total, min(value) as v_min, max(value) as v_max from events group by 1""", "total v_min v_max", digits=4)
def _(t):
    """Closed and open days over several micro-batches: update mode, merged on reading."""
    src, out, ck = _ordered_files(t, t.raw("events"), "ts", "events"), scratch_path(t.spark, "daily"), scratch_path(t.spark, "ck")
    _drain(J.state_sink(J.daily_rollup(J.file_stream(t.spark, src, EV_DDL)), out, ck))
    return J.merged(t.spark, out, ["day"])


@query("stream_site_watch", """select user_id, arg_max(value, (ts, event_id)) as latest_value, max(ts) as latest_ts, count(*) as n,
       case when max(ts) + interval 36 hour <= (select max(ts) from events where user_id is not null) then 1::bigint else 0::bigint end as stale from events where user_id is not null and ts is not null group by user_id""", "latest_value")
def _(t):
    """Keyed state with timers: a site turns stale when the watermark passes 36 hours of silence."""
    src, out, ck = _ordered_files(t, t.raw("events"), "ts", "events"), scratch_path(t.spark, "watch"), scratch_path(t.spark, "ck")
    with K.keyed_store(t.spark):
        _drain(J.state_sink(K.watch_sites(J.file_stream(t.spark, src, EV_DDL), 1.5), out, ck))
    return J.merged(t.spark, out, ["user_id"])


@query("stream_weather_join", """with r as (select o_orderkey as row_id, o_custkey % 7 + 1 as station, cast(o_orderdate as date) as ts from orders),
       w as (select l_linenumber::bigint as station, cast(l_shipdate as date) as ts, greatest(cast(sum(l_quantity) as bigint) % 10 - 5, 0) * 1e0 as precip from lineitem group by 1, 2)
       select r.row_id, w.ts as weather_ts, w.precip from r left join w on w.station = r.station and w.ts >= r.ts - interval 2 day and w.ts < r.ts""", "precip")
def _(t):
    """Readings and the weather of the two days before, both as streams; readings without any are there too. A heartbeat at the end
    of each stream moves the watermark past the last reading."""
    readings = t.readings.select("row_id", (F.col("entity_id") % 7 + 1).alias("station"), F.col("ts").cast("timestamp").alias("ts"))
    weather = t.station_daily.select("station", F.col("ts").cast("timestamp").alias("ts"), "precip")
    beat = lambda d, *cols: d.agg(F.max("ts").alias("m")).select(*[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in cols], F.expr("m + interval 1000 days").alias("ts"))
    a = _ordered_files(t, readings.unionByName(beat(readings, "row_id", "station")), "ts", "readings")
    b = _ordered_files(t, weather.unionByName(beat(weather, "station", "precip")), "ts", "weather")
    out, ck = scratch_path(t.spark, "joined"), scratch_path(t.spark, "ck")
    left, right = J.file_stream(t.spark, a, "row_id bigint, station bigint, ts timestamp"), J.file_stream(t.spark, b, "station bigint, ts timestamp, precip double")
    _drain(J.append_sink(K.with_weather(left, right, 2, ["row_id"], ["precip"]), out, ck))
    return t.spark.read.parquet(out).where("row_id is not null").select("row_id", F.to_date("weather_ts").alias("weather_ts"), "precip")


@query("history_incremental", "select row_id, prev_value, prior_count from hist where yr >= 2000", "prev_value")
def _(t):
    """Features of newly arrived readings from the day table of the old ones plus the new days: the old readings are
    never re-read."""
    old = durable(H.day_table(t.readings.where("yr < 2000")), "old-days")
    new = t.readings.where("yr >= 2000")
    days = old.unionByName(H.day_table(new))
    feats = H.prior_row_count(H.prior_levels(days)).where(F.year("ts") >= 2000)
    return H.attach(new, feats).select("row_id", "prev_value", "prior_count")
