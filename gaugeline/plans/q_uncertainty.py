"""Conformal intervals, applicability, nearest neighbours and rasters."""

from pyspark.sql import functions as F

from gaugeline.operators import proximity as N
from gaugeline.operators import raster as G
from gaugeline.operators import splits as S
from gaugeline.operators import uncertainty as U
from gaugeline.functions.scalars import close_to, haversine_km, haversine_km_atan2, right_closed_bin
from gaugeline.operators import gates as T
from gaugeline.plans.registry import query
from gaugeline.session import durable

CAL = "(select * from plog where split = 'validation')"
TEST = "(select * from plog where split = 'test')"


def _cut_sql(src, keys, rule, score="abs(y_pred - y_true)"):
    def k(a):
        if rule == "textbook":
            return f"least(ceil((n + 1) * {1 - a!r}e0), n)"
        return f"least(ceil(least(1e0, ceil((n + 1) * {1 - a!r}e0) / n) * (n - 1)) + 1, n)"
    kk = keys + ", " if keys else ""
    return f"""select {kk}max(n) as n, max(s) filter (rn = {k(.1)}) as q90, max(s) filter (rn = {k(.05)}) as q95 from (select {kk}{score} as s,
       row_number() over ({'partition by ' + keys if keys else ''} order by {score}) as rn, count(*) over ({'partition by ' + keys if keys else ''}) as n from {src}) {'group by ' + keys if keys else ''}"""


@query("conformal_cutoff", f"select 'textbook' as rule, * from ({_cut_sql(CAL, 'model, cohort', 'textbook')}) union all select 'upper', * from ({_cut_sql(CAL, 'model, cohort', 'upper')})", "q90 q95")
def _(t):
    cal = t.prediction_log.where("split = 'validation'")
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    return U.conformal_cutoff(cal, e, U.LEVELS, ["model", "cohort"]).withColumn("rule", F.lit("textbook")).unionByName(
        U.conformal_cutoff(cal, e, U.LEVELS, ["model", "cohort"], "upper").withColumn("rule", F.lit("upper")))


def _intervals(t):
    p = t.prediction_log
    return U.conformal_intervals(p.where("split = 'validation'"), p.where("split = 'test'"), ["model"])


IV = {
    "ci_own": f"select * from ({_cut_sql(CAL, 'model, cohort', 'textbook')}) where n >= 15 or cohort <> 'cold'",
    "ci_all": _cut_sql(CAL, "model", "textbook"),
    "iv": f"""select t.*, y_pred - coalesce(o.q90, a.q90) as lower_90, y_pred + coalesce(o.q90, a.q90) as upper_90, y_pred - coalesce(o.q95, a.q95) as lower_95, y_pred + coalesce(o.q95, a.q95) as upper_95,
        2 * coalesce(o.q90, a.q90) as width_90, 2 * coalesce(o.q95, a.q95) as width_95, (abs(y_true - y_pred) <= coalesce(o.q90, a.q90))::int::double as covered_90, (abs(y_true - y_pred) <= coalesce(o.q95, a.q95))::int::double as covered_95
        from {TEST} t left join ci_own o using (model, cohort) left join ci_all a using (model)""",
    "cqs": f"select model, y_true, y_pred, split, cohort, row_id, floor(y_pred * 0.75e0) as lo, floor(y_pred * 1.125e0) as hi from plog where split <> 'train'",
    "cqc": _cut_sql("(select * from cqs where split = 'validation')", "model", "textbook", "greatest(lo - y_true, y_true - hi)"),
    "cqi": "select c.*, lo - q90 as cqr_lower_90, hi + q90 as cqr_upper_90, hi + q90 - (lo - q90) as cqr_width_90, (y_true between lo - q90 and hi + q90)::int::double as cqr_covered_90 from cqs c join cqc using (model) where split = 'test'",
}


def q(name, sql, doubles="", digits=6):
    return query(name, sql, doubles, digits, extra=IV)


@q("conformal_intervals", "select row_id, model, lower_90, upper_90, lower_95, upper_95, covered_90, covered_95 from iv", "lower_90 upper_90 lower_95 upper_95 covered_90 covered_95")
def _(t):
    return _intervals(t).select("row_id", "model", "lower_90", "upper_90", "lower_95", "upper_95", "covered_90", "covered_95")


def _cqr(t):
    d = t.prediction_log.where("split <> 'train'").withColumn("lo", F.floor(F.col("y_pred") * 0.75).cast("double")).withColumn("hi", F.floor(F.col("y_pred") * 1.125).cast("double"))
    return U.cqr_intervals(d.where("split = 'validation'"), d.where("split = 'test'"), ["model"], "lo", "hi")


@q("cqr_intervals", "select row_id, model, cqr_lower_90, cqr_upper_90, cqr_width_90, cqr_covered_90 from cqi", "cqr_lower_90 cqr_upper_90 cqr_width_90 cqr_covered_90")
def _(t):
    return _cqr(t).select("row_id", "model", "cqr_lower_90", "cqr_upper_90", "cqr_width_90", "cqr_covered_90")


@q("interval_metrics", """select model, cohort, count(*) as n, avg(covered_90) as coverage, avg(covered_90) - 0.9e0 as coverage_deviation, avg(width_90) as mean_width, avg(abs(y_pred - y_true)) as mae,
       sqrt(avg(pow(y_pred - y_true, 2))) as rmse, avg(y_pred - y_true) as mean_error, quantile_cont(width_90, .5) as median_width, quantile_cont(width_90, .9) as p90_width, quantile_cont(width_90, .95) as p95_width,
       quantile_cont(abs(y_pred - y_true), .5) as medae, quantile_cont(abs(y_pred - y_true), .9) as p90_ae, quantile_cont(abs(y_pred - y_true), .95) as p95_ae from iv group by model, cohort""",
   "coverage coverage_deviation mean_width mae rmse mean_error median_width p90_width p95_width medae p90_ae p95_ae")
def _(t):
    return U.interval_metrics(_intervals(t), ["model", "cohort"])


@q("calibration_summary", f"""select c.*, 2 * q90 as width_90, 2 * q95 as width_95, m.mean_residual, m.median_residual from ({_cut_sql(CAL, 'model', 'textbook')}) c
       join (select model, avg(abs(y_pred - y_true)) as mean_residual, median(abs(y_pred - y_true)) as median_residual from plog where split = 'validation' group by 1) m using (model)""",
   "q90 q95 width_90 width_95 mean_residual median_residual")
def _(t):
    return U.calibration_summary(t.prediction_log.where("split = 'validation'"), ["model"])


@q("cqr_vs_conformal", """select model, cohort, count(*) as n, avg(covered_90) as coverage, avg(cqr_covered_90) as cqr_coverage, avg(width_90) as width, avg(cqr_width_90) as cqr_width, avg(cqr_width_90) - avg(width_90) as width_change
       from iv join (select row_id, model, cqr_width_90, cqr_covered_90 from cqi) using (row_id, model) group by model, cohort""", "coverage cqr_coverage width cqr_width width_change")
def _(t):
    j = _intervals(t).join(_cqr(t).select("row_id", "model", "cqr_width_90", "cqr_covered_90"), ["row_id", "model"])
    return U.cqr_vs_conformal(j, ["model", "cohort"])


# applicability --------------------------------------------------------------------------------------------------------

MAHA = """with c as (select avg(l_quantity) as ma, avg(l_discount) as mb, avg(l_tax) as mc, var_samp(l_quantity) as aa, var_samp(l_discount) as bb, var_samp(l_tax) as cc, covar_samp(l_quantity, l_discount) as ab,
         covar_samp(l_quantity, l_tax) as ac, covar_samp(l_discount, l_tax) as bc from lineitem where l_shipdate < timestamp '1999-01-01'),
       r as (select ma, mb, mc, aa + 1e-4 * (aa + bb + cc) as aa, bb + 1e-4 * (aa + bb + cc) as bb, cc + 1e-4 * (aa + bb + cc) as cc, ab, ac, bc from c),
       d as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from r)
       select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint as l_linenumber, sqrt(((bb * cc - bc * bc) * x * x + (aa * cc - ac * ac) * y * y + (aa * bb - ab * ab) * z * z + 2 * (ac * bc - ab * cc) * x * y + 2 * (ab * bc - ac * bb) * x * z
         + 2 * (ab * ac - aa * bc) * y * z) / det) as mahalanobis from (select *, l_quantity - ma as x, l_discount - mb as y, l_tax - mc as z from lineitem, d)"""


@query("mahalanobis_distance", MAHA, "mahalanobis", digits=5)
def _(t):
    li = t.raw("lineitem")
    d = U.mahalanobis_distance(li.where("l_shipdate < timestamp '1999-01-01'"), li, ["l_quantity", "l_discount", "l_tax"])
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "mahalanobis")


RANGE = ["prev_value", "gap_days", "density", "hist_std", "temp_mean"]


@query("out_of_range_count", "select *, case when out_of_range > 0 then 1::bigint else 0::bigint end as extrapolative from (select row_id, " + " + ".join(f"coalesce(({c} < (select min({c}) from model_rows where yr <= 1998) or {c} > (select max({c}) from model_rows where yr <= 1998))::bigint, 0)" for c in RANGE) + " as out_of_range from model_rows)")
def _(t):
    d = U.out_of_range_count(t.model_rows, U.training_ranges(t.model_rows.where("yr <= 1998"), RANGE))
    return d.select("row_id", "out_of_range", "extrapolative")


@query("model_disagreement", "select a.row_id, abs(a.y_pred - b.y_pred) as disagreement from predictions a join predictions b using (row_id) where a.model = 'm1' and b.model = 'm2'", "disagreement")
def _(t):
    return U.model_disagreement(t.predictions, "m1", "m2")


def _ev(src, signal, expr):
    return f"""select '{signal}' as signal, {expr} as bin, count(*) as n, avg(abs(y_pred - y_true)) as mae, avg(width_90) as mean_width, avg(covered_90) as coverage, avg(covered_95) as coverage_95, median(abs(y_pred - y_true)) as medae from {src} group by 2"""


EV1 = "(select iv.* exclude (gap_days, prior_count), h.gap_days, h.prior_count, h.density, abs(iv.y_pred - p2.y_pred) as disagreement from iv join (select row_id, gap_days, prior_count, density from hist) h using (row_id) join (select row_id, y_pred from predictions where model = 'm2') p2 using (row_id) where iv.model = 'm1')"


@q("reliability_evidence", f"""with e as {EV1}, eq as (select quantile_cont(density, .25) as d1, quantile_cont(density, .5) as d2, quantile_cont(density, .75) as d3, quantile_cont(disagreement, .25) as g1, quantile_cont(disagreement, .5) as g2, quantile_cont(disagreement, .75) as g3 from e)
       {_ev('(select * from e where gap_days is not null)', 'gap_days', "case when gap_days <= 180 then '0-6mo' when gap_days <= 365 then '6mo-1yr' when gap_days <= 730 then '1-2yr' when gap_days <= 1825 then '2-5yr' else '>5yr' end")}
       union all {_ev('e', 'prior_count', "case when prior_count <= 0 then '0' when prior_count <= 5 then '1-5' when prior_count <= 15 then '6-15' when prior_count <= 30 then '16-30' else '>30' end")}
       union all {_ev('e, eq', 'density', "'Q' || (1 + (density > d1)::int + (density > d2)::int + (density > d3)::int)")}
       union all {_ev('e, eq', 'disagreement', "'Q' || (1 + (disagreement > g1)::int + (disagreement > g2)::int + (disagreement > g3)::int)")}""", "mae mean_width coverage coverage_95 medae")
def _(t):
    d = _intervals(t).where("model = 'm1'").join(U.model_disagreement(t.predictions, "m1", "m2"), "row_id").join(t.history.select("row_id", "density"), "row_id")
    d = durable(d, "evidence")                             # read ten times below
    cols = ["signal", "bin", "n", "mae", "mean_width", "coverage", "coverage_95", "medae"]
    parts = [U.evidence(d.where("gap_days is not null"), "gap_days", right_closed_bin("gap_days", *U.GAP_BINS)), U.evidence(d, "prior_count", right_closed_bin("prior_count", *U.COUNT_BINS)),
             U.quantile_evidence(d, "density", 4), U.quantile_evidence(d, "disagreement", 4)]
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out


HAV = "2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


APP = f"""with e as (select iv.*, h.prior_count::double as x, h.density as z from (select * exclude (prior_count, gap_days) from iv where model = 'm1') iv join (select row_id, prior_count, density from hist) h using (row_id)),
       tr as (select avg(prior_count::double) as mx, avg(density) as mz, var_samp(prior_count::double) as vx, var_samp(density) as vz, covar_samp(prior_count::double, density) as c from hist where yr <= 1998),
       m as (select mx, mz, c, vx + 1e-4 * (vx + vz) as a, vz + 1e-4 * (vx + vz) as d from tr),
       f as (select e.*, round(sqrt(greatest(0, (d * (x - mx) * (x - mx) - 2 * c * (x - mx) * (z - mz) + a * (z - mz) * (z - mz)) / (a * d - c * c))), 4) as dm from e, m),
       eq as (select quantile_cont(dm, .2) as e1, quantile_cont(dm, .4) as e2, quantile_cont(dm, .6) as e3, quantile_cont(dm, .8) as e4 from f),
       s as (select entity_id, row_number() over (order by md5(entity_id::varchar || '_42'), entity_id) <= ceil(0.2 * count(*) over ()) as test from (select distinct entity_id from readings)),
       x as (select sites.*, s.test from sites join s using (entity_id)),
       k as (select a.entity_id, round(min({HAV}), 4) as km from x a, x b where a.test and not b.test group by a.entity_id),
       g as (select e.*, k.km from e join k using (entity_id))
       {_ev('f, eq', 'mahalanobis', "'Q' || (1 + (dm > e1)::int + (dm > e2)::int + (dm > e3)::int + (dm > e4)::int)")}
       union all {_ev('g', 'train_site_km', "case when km <= 2 then '0-2km' when km <= 5 then '2-5km' when km <= 10 then '5-10km' when km <= 20 then '10-20km' else '>20km' end")}"""


@q("applicability_audit", APP, "mae mean_width coverage coverage_95 medae")
def _(t):
    """Error and coverage by distance to the training data: in feature space (quintiles) and on the ground (fixed bins,
    rows of sites that the training part has never seen)."""
    own = durable(_intervals(t).where("model = 'm1'").drop("prior_count", "gap_days", "density"), "intervals")     # read six times below
    h = t.history.selectExpr("row_id", "yr", "cast(prior_count as double) as prior_count", "density")
    far = U.mahalanobis_distance(h.where("yr <= 1998"), own.join(h.drop("yr"), "row_id"), ["prior_count", "density"]).withColumn("mahalanobis", F.round("mahalanobis", 4))
    far = durable(far, "far")                              # read five times below
    x = t.sites.join(S.split_unseen_entities(t.readings.select("entity_id").distinct()), "entity_id")
    km = N.nearest_km(x.where("split = 'test'"), x.where("split = 'train'"), exclude_same=False).select("entity_id", F.round("nearest_km", 4).alias("km"))
    ground = U.evidence(durable(own.join(km, "entity_id"), "ground"), "train_site_km", right_closed_bin("km", *U.SITE_KM_BINS))
    cols = ["signal", "bin", "n", "mae", "mean_width", "coverage", "coverage_95", "medae"]
    return U.quantile_evidence(far, "mahalanobis", 5).select(cols).unionByName(ground.select(cols))


@query("nearest_neighbor_km", f"""with mon as (select * from sites where entity_id in (select entity_id from readings group by 1 having count(distinct ts) > 1)) select a.entity_id, min({HAV}) as nearest_km from sites a join mon b on a.entity_id <> b.entity_id group by a.entity_id""", "nearest_km")
def _(t):
    many = t.readings.groupBy("entity_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("a < b").select("entity_id")
    return N.nearest_km(t.sites, t.sites.join(many, "entity_id", "left_semi"))


@query("nearest_train_km", f"""with s as (select entity_id, row_number() over (order by md5(entity_id::varchar || '_42'), entity_id) <= ceil(0.2 * count(*) over ()) as test from (select distinct entity_id from readings)),
       x as (select sites.*, s.test from sites join s using (entity_id)) select a.entity_id, min({HAV}) as nearest_km from x a, x b where a.test and not b.test group by a.entity_id""", "nearest_km")
def _(t):
    x = t.sites.join(S.split_unseen_entities(t.readings.select("entity_id").distinct()), "entity_id")
    return N.nearest_km(x.where("split = 'test'"), x.where("split = 'train'"), exclude_same=False)


HAV2 = "2 * 6371e0 * atan2(sqrt(least(1e0, h)), sqrt(1 - least(1e0, h)))"


@query("geo_distance_forms", f"""select entity_id, {HAV2} as km, 1::bigint as agree from
       (select entity_id, pow(sin(radians(40.5e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.5e0)) * pow(sin(radians(-99.4e0 - lon) / 2), 2) as h from sites)""", "km")
def _(t):
    """Distance of every site to one point by the atan2 form, and whether the arcsine form agrees."""
    to = (F.lit(40.5), F.lit(-99.4))
    km = haversine_km_atan2("lat", "lon", *to)
    return t.sites.select("entity_id", km.alias("km"), close_to(haversine_km("lat", "lon", *to), km, 1e-9, 1e-9).cast("bigint").alias("agree"))


@q("interval_gates", """select 'bounds_ordered' as gate, count(*) filter (lower_90 > upper_90) as violations from iv union all
       select 'bounds_nested', count(*) filter (lower_95 > lower_90 + 1e-9 or upper_95 < upper_90 - 1e-9) from iv""")
def _(t):
    return T.interval_gates(_intervals(t)).select("gate", "violations")


@q("interval_gates_faults", """select 'bounds_ordered' as gate, count(*) filter (row_id % 5 = 0 and upper_90 > lower_90) as violations from iv union all
       select 'bounds_nested', count(*) filter (case when row_id % 5 = 0 then lower_95 > upper_90 + 1e-9 or upper_95 < lower_90 - 1e-9 else lower_95 > lower_90 + 1e-9 or upper_95 < upper_90 - 1e-9 end) from iv""")
def _(t):
    """Every fifth row has its bounds exchanged, which the gates must report."""
    d, bad = _intervals(t), F.col("row_id") % 5 == 0
    swapped = d.withColumns({"lower_90": F.when(bad, F.col("upper_90")).otherwise(F.col("lower_90")), "upper_90": F.when(bad, F.col("lower_90")).otherwise(F.col("upper_90"))})
    return T.interval_gates(swapped).select("gate", "violations")


# rasters --------------------------------------------------------------------------------------------------------------

GRID = dict(left=-99.65, top=40.69, res_x=0.0157, res_y=0.0116)
PTS = f"""(select r.row_id, r.yr, r.value, floor((40.69e0 - s.lat) / 0.0116e0)::int as r, floor((s.lon - -99.65e0) / 0.0157e0)::int as c from readings r join sites s using (entity_id))"""


def _points(t):
    return G.cell_index(t.readings.select("row_id", "entity_id", "yr", "value").join(t.sites.select("entity_id", "lat", "lon"), "entity_id"), **GRID)


@query("raster_sample_at_points", f"select p.row_id, p.r::bigint as r, p.c::bigint as c, x.cell from {PTS} p left join raster x on x.yr = p.yr and x.r = p.r and x.c = p.c", "cell")
def _(t):
    return G.sample_at_points(_points(t), t.raster).select("row_id", "r", "c", "cell")


@query("raster_yearly_stats", "select yr::bigint as yr, count(cell) as valid, count(*) - count(cell) as empty, min(cell) as v_min, max(cell) as v_max, avg(cell) as mean, stddev_pop(cell) as std, median(cell) as median from raster group by yr", "v_min v_max mean std median")
def _(t):
    return G.yearly_stats(t.raster)


@query("raster_grid_consistency", """select yr::bigint as yr, 1::bigint as same_width, case when h = (select max(r) + 1 from raster where yr = (select min(yr) from raster)) then 1::bigint else 0::bigint end as same_height, 1::bigint as same_crs,
       case when yr % 3 = (select min(yr) % 3 from raster) then 1::bigint else 0::bigint end as same_res_x, 1::bigint as same_res_y, 1::bigint as same_left, 1::bigint as same_top,
       case when yr % 3 = (select min(yr) % 3 from raster) then 1::bigint else 0::bigint end as consistent from (select yr, max(r) + 1 as h from raster group by yr)""")
def _(t):
    meta = t.raster.groupBy("yr").agg((F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height")).selectExpr(
        "yr", "width", "height", "'EPSG:4326' as crs", "0.0157d + (yr % 3) * 1e-3 as res_x", "0.0116d as res_y", "-99.65d as left", "40.69d as top")
    return G.grid_consistency(meta)


FLIP = """select 'native' as orientation, p.yr, p.value, p.r, p.c from {p} p union all select 'vertical', yr, value, 29 - r, c from {p} union all select 'horizontal', yr, value, r, 29 - c from {p} union all select 'both', yr, value, 29 - r, 29 - c from {p}""".format(p=PTS)


def _om(keys):
    return f"""select {keys}, count(*) as n, 1 - sum(pow(cell - value, 2)) / (sum(value * value) - sum(value) * sum(value) / count(*)) as r2, avg(abs(cell - value)) as mae, sqrt(avg(pow(cell - value, 2))) as rmse,
      corr(value, cell) as pearson from (select f.orientation, f.yr::bigint as yr, f.value, x.cell from ({FLIP}) f join raster x on x.yr = f.yr and x.r = f.r and x.c = f.c where x.cell is not null) group by {keys}"""


OC = "r2 mae rmse pearson"


@query("orientation_diagnostic", _om("orientation"), OC)
def _(t):
    return G.orientation_diagnostic(_points(t), t.raster, 30, 30).select("orientation", "n", *OC.split())


@query("orientation_by_year", _om("orientation, yr"), OC)
def _(t):
    return G.orientation_diagnostic(_points(t), t.raster, 30, 30, ("orientation", "yr")).select("orientation", "yr", "n", *OC.split())


@query("orientation_choice", f"select orientation, pearson from ({_om('orientation')}) order by abs(pearson) desc, orientation limit 1", "pearson")
def _(t):
    return G.choose_orientation(G.orientation_diagnostic(_points(t), t.raster, 30, 30)).select("orientation", "pearson")


@query("raster_corrected_validation", f"""select yr::bigint as yr, count(*) as n, avg(abs(cell - value)) as mae, sqrt(avg(pow(cell - value, 2))) as rmse, avg(cell - value) as mean_error, {', '.join(f'count(*) filter (abs(cell - value) > {k}) as over_{k}' for k in G.THRESHOLDS)}
       from (select p.yr, p.value, x.cell from {PTS} p join raster x on x.yr = p.yr and x.r = 29 - p.r and x.c = p.c where x.cell is not null) group by yr""", "mae rmse mean_error")
def _(t):
    pts = G.flipped_points(_points(t), 30, 30).where("orientation = 'vertical'")
    return G.corrected_validation(G.sample_at_points(pts, t.raster)).select("yr", "n", "mae", "rmse", "mean_error", *[f"over_{k}" for k in G.THRESHOLDS])
