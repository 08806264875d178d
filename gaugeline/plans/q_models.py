"""Models of many splits from one scan, folds, clusters with restarts, quantile boosting, exact tree attributions."""

from functools import reduce

from pyspark.sql import functions as F

from gaugeline.config import BLOCKS
from gaugeline.operators import attribution as A
from gaugeline.operators import clusters as K
from gaugeline.operators import learn as L
from gaugeline.operators import metrics as M
from gaugeline.operators import quantile_boost as Q
from gaugeline.operators import studies as ST
from gaugeline.operators import trees as T
from gaugeline.plans.registry import query
from gaugeline.session import durable

SEEDS = [42, 101, 202, 303, 404, 505, 606, 707, 808, 909]
SET_A = BLOCKS["c"] + BLOCKS["b"]
SET_B = SET_A + BLOCKS["a"][:12]
SETS = {"A": SET_A, "B": SET_B, "C": SET_B + BLOCKS["a"][12:]}
LAGS = ["prev_value", "gap_days", "roll3_mean", "roll3_std", "hist_mean", "prior_count", "density"]
KEEP = ["row_id", "entity_id", "ts", "cohort"]
MET = ["n", "r2", "mae", "rmse"]
HELD = f"""select seed, entity_id from (select seed, entity_id, row_number() over (partition by seed order by md5(entity_id::varchar || '_' || seed), entity_id) <= ceil(0.2 * count(*) over (partition by seed)) as test
    from (select distinct entity_id from readings), (select unnest({SEEDS}) as seed)) where test"""


def flag(c):
    return F.when(c, 1).otherwise(0).cast("bigint")


def _rows(t):
    d = durable(t.signal_rows, "signal-rows")
    return d.withColumn("cohort", F.when(F.col("prior_count") > 0, "warm").otherwise("cold"))


def _held(t, d):
    return durable(d.join(ST.held_out(t.readings, SEEDS), "entity_id"), "held")


# many models from one scan ---------------------------------------------------------------------------------------------

ONE = ["prev_value", "gap_days", "density", "precip_total", "elev"]
ONE_SQL = " union all ".join(f"""select '{c}' as feature_set, m.seed, m.n, m.slope, m.intercept, e.rows, e.mae, e.rmse from
    (select seed, any_value(fill) as fill, count(*) as n, regr_slope(level, coalesce({c}, fill)) as slope, regr_intercept(level, coalesce({c}, fill)) as intercept
     from (select h.seed, level, {c}, avg({c}) over (partition by h.seed) as fill from (select unnest({SEEDS}) as seed) h, signal_rows s where not exists (select 1 from heldout x where x.seed = h.seed and x.entity_id = s.entity_id)) group by seed) m
    join lateral (select count(*) as rows, avg(abs(m.intercept + m.slope * coalesce({c}, m.fill) - level)) as mae, sqrt(avg((m.intercept + m.slope * coalesce({c}, m.fill) - level) ** 2)) as rmse
     from signal_rows s join heldout x on x.seed = m.seed and x.entity_id = s.entity_id) e on true""" for c in ONE)


@query("repeated_linear_closed_form", ONE_SQL, "slope intercept mae rmse", digits=5, extra={"heldout": HELD})
def _(t):
    """One-feature models of ten splits, all from one scan, against the closed form."""
    d, sets = _held(t, _rows(t)), {c: [c] for c in ONE}
    models = durable(ST.linear_models(d, SEEDS, sets, "level"), "models")
    e = F.col("y_pred") - F.col("y_true")
    got = ST.linear_log(d, models, sets, "level", ["row_id"]).groupBy("split", "feature_set").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    slope = F.aggregate("beta", F.lit(0.0), lambda a, b: a + b)
    return models.join(got, ["split", "feature_set"]).select("feature_set", F.col("split").alias("seed"), "n", slope.alias("slope"), "intercept", "rows", "mae", "rmse")


def _repeated(t):
    d = _held(t, _rows(t))
    models = durable(ST.linear_models(d, SEEDS, SETS, "level"), "models")
    log = ST.linear_log(d, models, SETS, "level", KEEP)
    return M.metrics_by_cohort_sets(log, ["split", "feature_set"], "cohort").select(F.col("split").alias("seed"), "feature_set", "cohort", *MET)


@query("repeated_evaluation")
def _(t):
    """Ten splits by entity, three feature sets, cohorts: thirty linear models from one scan."""
    return _repeated(t)


@query("repeated_evaluation_checks", f"""select x.seed, f.feature_set, c.cohort, count(*) as n, 1::bigint as learned
    from signal_rows s join heldout x using (entity_id), (select unnest(['A', 'B', 'C']) as feature_set) f, (select unnest(['overall', 'warm', 'cold']) as cohort) c
    where c.cohort = 'overall' or c.cohort = case when prior_count > 0 then 'warm' else 'cold' end group by all""", extra={"heldout": HELD})
def _(t):
    """Every run scores exactly its test rows, and history helps: sets B and C explain warm rows better than A does."""
    m = durable(_repeated(t), "repeated")
    ref = m.where("feature_set = 'A'").select("seed", "cohort", F.col("mae").alias("base"))
    better = (F.col("feature_set") == "A") | (F.col("cohort") != "warm") | (F.col("mae") < F.col("base"))
    return m.join(ref, ["seed", "cohort"]).select("seed", "feature_set", "cohort", "n", flag(better).alias("learned"))


#: Nested sets of the ablation: places, elevation, climate, history, and what tells of the monitoring itself.
NESTED = {"A0": ["lat", "lon"], "A1": SET_A[:3], "A2": SET_A, "A3": SET_B, "A4": SETS["C"]}


def _ablation(t):
    """Nested feature sets over ten splits, fifty models from one scan: metrics by cohort and the change from each set to the next."""
    d = _held(t, _rows(t))
    models = durable(ST.linear_models(d, SEEDS, NESTED, "level"), "models")
    m = durable(M.metrics_by_cohort_sets(ST.linear_log(d, models, NESTED, "level", KEEP), ["split", "feature_set"], "cohort").select("split", "feature_set", "cohort", *MET), "ablation")
    ahead = F.concat(F.lit("A"), (F.substring("feature_set", 2, 1).cast("int") + 1).cast("string"))
    before = m.select("split", "cohort", ahead.alias("feature_set"), F.col("mae").alias("mae_before"), F.col("r2").alias("r2_before"))
    j = m.join(before, ["split", "cohort", "feature_set"], "left")
    return j.groupBy("feature_set", "cohort").agg(F.count(F.lit(1)).alias("runs"), F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("mae_std"), F.avg("r2").alias("r2"),
                                                 F.avg((F.col("mae") - F.col("mae_before")) / F.col("mae_before") * 100).alias("mae_change_pct"), F.avg(F.col("r2") - F.col("r2_before")).alias("r2_gain"))


query("ablation_repeated")(_ablation)


@query("ablation_repeated_checks", """select f.feature_set, c.cohort, 10::bigint as runs, case when f.feature_set = 'A0' then 0::bigint when f.feature_set = 'A3' and c.cohort <> 'cold' then 1::bigint end as helps
    from (select unnest(['A0', 'A1', 'A2', 'A3', 'A4']) as feature_set) f, (select unnest(['overall', 'warm', 'cold']) as cohort) c""")
def _(t):
    """Every set is run on every split; adding the history lowers the error of all and of warm rows."""
    m = _ablation(t)
    helps = F.when(F.col("feature_set") == "A0", F.when(F.col("mae_change_pct").isNull(), 0)).when((F.col("feature_set") == "A3") & (F.col("cohort") != "cold"), flag(F.col("mae_change_pct") < -5))
    return m.select("feature_set", "cohort", "runs", helps.cast("bigint").alias("helps"))


# clusters and folds ----------------------------------------------------------------------------------------------------

RESTARTS, STEPS, CENTRES = 10, 20, 5


def _kmeans_sql() -> dict[str, str]:
    near = lambda i: f"select p.entity_id, p.x, p.y, c.r, min(((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) * 8 + c.k) as v from kp p, kc{i} c group by all"
    mean = lambda c: f"(sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*)"
    out = {"kp": f"""select entity_id, floor((lat - ma) / sa * {K.GRID} + 0.5)::bigint as x, floor((lon - mo) / so * {K.GRID} + 0.5)::bigint as y
               from sites, (select avg(lat) as ma, stddev_samp(lat) as sa, avg(lon) as mo, stddev_samp(lon) as so from sites)""",
           "kc0": f"""select r, (row_number() over (partition by r order by md5(entity_id::varchar || '_' || r), entity_id) - 1)::bigint as k, x, y
               from kp, (select unnest(range({RESTARTS})) as r) qualify k < {CENTRES}"""}
    for i in range(STEPS):
        out[f"kn{i}"] = near(i)
        out[f"kc{i + 1}"] = f"""select c.r, c.k, coalesce(m.x, c.x)::bigint as x, coalesce(m.y, c.y)::bigint as y from kc{i} c
            left join (select r, v % 8 as k, {mean('x')} as x, {mean('y')} as y from kn{i} group by all) m using (r, k)"""
    out[f"kn{STEPS}"] = near(STEPS)
    out["clustered"] = f"""select entity_id, (v % 8)::bigint as cluster from kn{STEPS} where r = (select r from kn{STEPS} group by r order by sum(v // 8), r limit 1)"""
    return out


KMEANS_SQL = _kmeans_sql()


def _clusters(t):
    return K.kmeans(t.sites, k=CENTRES, restarts=RESTARTS, steps=STEPS)


@query("kmeans_restarts", "select entity_id, cluster from clustered", extra=KMEANS_SQL)
def _(t):
    """Ten restarts of k-means, the one with the least inertia: exact labels."""
    return _clusters(t)


LEARNERS = {"linear": {}, "forest": {"trees": 10, "depth": 5}, "boosted": {"rounds": 5, "depth": 3}}


def _spatial(t, sets):
    d = _rows(t).join(_clusters(t), "entity_id")
    log = ST.fold_log(durable(d, "clustered"), "cluster", CENTRES, sets, "level", LEARNERS, KEEP)
    return M.metrics_by_cohort_sets(log, ["fold", "feature_set", "learner"], "cohort").select("fold", "feature_set", "learner", "cohort", *MET)


@query("spatial_folds")
def _(t):
    """Leave one cluster out: three feature sets and three learners over the given folds, metrics by cohort."""
    return _spatial(t, SETS)


@query("spatial_folds_checks", """select c.cluster as fold, l.learner, o.cohort, count(*) as n from model_rows m join clustered c using (entity_id), (select unnest(['linear', 'forest', 'boosted']) as learner) l, (select unnest(['overall', 'warm', 'cold']) as cohort) o
    where o.cohort = 'overall' or o.cohort = case when prior_count > 0 then 'warm' else 'cold' end group by all""", extra=KMEANS_SQL)
def _(t):
    """Each fold scores the rows of its cluster, once per learner and cohort."""
    return _spatial(t, {"A": SET_A}).select("fold", "learner", "cohort", "n")


@query("fold_disjointness", "select count(distinct entity_id) as entities, 5::bigint as folds, 0::bigint as shared from model_rows join sites using (entity_id)")
def _(t):
    per = t.model_rows.join(_clusters(t), "entity_id").groupBy("entity_id").agg(F.countDistinct("cluster").alias("c"), F.max("cluster").alias("cluster"))
    return per.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("cluster").alias("folds"), F.count_if(F.col("c") > 1).alias("shared"))


# response studies ------------------------------------------------------------------------------------------------------

H13 = ["prev_value", "prev2_value", "gap_days", "gap_years", "prior_count", "roll3_mean", "roll3_std", "prev_change", "recent_trend", "hist_mean", "hist_std", "hist_min", "hist_max"]
RAIN = [f"precip_{n}d" for n in (7, 14, 30, 60, 90, 180)]
EVENTS = ["rain_days_30d", "max_precip_30d", "dry_spell_days"]
AIR = ["temp_mean_30d", "temp_max_30d", "radiation_30d", "rh_mean_30d", "wind_mean_30d"]
PLACE = ["lat", "lon", "elev"]
#: Families of features behind the change since the last reading.
FAMILIES = {"S0": PLACE, "S1": PLACE + H13, "S2": PLACE + H13 + AIR, "S3": PLACE + H13 + RAIN, "S4": PLACE + H13 + RAIN + ["precip_interval"], "S5": PLACE + H13 + RAIN + EVENTS + ["precip_interval"] + AIR}
MAIN = {k: FAMILIES[k] for k in ("S1", "S4", "S5")}


def _responses(t):
    return durable(t.response.where("delta is not null"), "response")


@query("response_family_ablation")
def _(t):
    """Six families of features, one temporal split, one scan: metrics on later readings."""
    d = _responses(t).where("yr <= 1998 or yr >= 2000").withColumn("held", F.when(F.col("yr") >= 2000, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    models = durable(ST.linear_models(d, [0], FAMILIES, "delta"), "models")
    return L.log_metrics(ST.linear_log(d, models, FAMILIES, "delta", ["row_id"]), ["feature_set"]).select("feature_set", *MET)


def _response_repeated(t):
    d = durable(t.response.where("delta is not null").join(ST.held_out(t.readings, SEEDS), "entity_id"), "held")
    models = durable(ST.linear_models(d, SEEDS, MAIN, "delta"), "models")
    return L.log_metrics(ST.linear_log(d, models, MAIN, "delta", ["row_id"]), ["split", "feature_set"]).select(F.col("split").alias("seed"), "feature_set", *MET)


query("response_repeated")(_response_repeated)


@query("response_repeated_checks", "select x.seed, f.feature_set, count(*) as n, 1::bigint as learned from hist h join heldout x using (entity_id), (select unnest(['S1', 'S4', 'S5']) as feature_set) f where h.prev_value is not null group by all", extra={"heldout": HELD})
def _(t):
    """Every run scores the warm rows of its test sites, and explains some of the change."""
    return _response_repeated(t).select("seed", "feature_set", "n", flag(F.col("r2") > 0.2).alias("learned"))


@query("response_spatial")
def _(t):
    """Leave one cluster out, three families, two learners."""
    d = durable(_responses(t).join(_clusters(t), "entity_id"), "clustered")
    log = ST.fold_log(d, "cluster", CENTRES, MAIN, "delta", {k: LEARNERS[k] for k in ("linear", "forest")}, ["row_id", "entity_id"])
    return L.log_metrics(log, ["fold", "feature_set", "learner"]).select("fold", "feature_set", "learner", *MET)


# quantile boosting -----------------------------------------------------------------------------------------------------

PROBS = {"q05": .05, "q50": .5, "q95": .95}
BOOST = LAGS + ["elev"]


def _boosted(t, rounds=8):
    d = _rows(t)
    train, test = d.where("yr <= 1998"), d.where("yr >= 2000")
    m = Q.fit(train, BOOST, "level", PROBS, rounds=rounds)
    return train, test, m.predict(test, ["row_id", "level"])


@query("quantile_boosting")
def _(t):
    """5 %, 50 % and 95 % quantiles of later readings by boosting on the pinball loss."""
    return _boosted(t)[2]


@query("quantile_boosting_checks", "select count(*) as n, 0::bigint as crossed, 1::bigint as covers, 1::bigint as beats_forest from model_rows where yr >= 2000")
def _(t):
    """No crossing, the 90 % band holds 80 to 97 % of the later rows, and the loss is below that of the leaf forest of as many trees."""
    train, test, p = _boosted(t)
    p = durable(p, "boosted")
    forest = L.leaf_quantiles(train, test, BOOST, "level", PROBS, ["row_id"], trees=8, depth=3)
    loss = lambda d, y: d.agg(reduce(lambda a, b: a + b, [F.avg(Q.pinball(F.col(y), F.col(n), q)) for n, q in PROBS.items()]).alias("loss"))
    theirs = loss(forest, "y_true").withColumnRenamed("loss", "forest")                                   # one row
    own = p.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("q05") > F.col("q50")) | (F.col("q50") > F.col("q95"))).alias("crossed"), F.avg(F.when((F.col("level") >= F.col("q05")) & (F.col("level") <= F.col("q95")), 1.0).otherwise(0.0)).alias("cover"))
    both = own.crossJoin(F.broadcast(theirs)).crossJoin(F.broadcast(loss(p, "level")))
    return both.select("n", "crossed", flag(F.col("cover").between(0.8, 0.97)).alias("covers"), flag(F.col("loss") < F.col("forest")).alias("beats_forest"))


# exact tree attributions -----------------------------------------------------------------------------------------------

def _tree_attributions(t, learner="forest", **kw):
    d = _rows(t)
    f = L.fit(d.where("yr <= 1998"), LAGS, "level", learner, **kw)
    return T.attributions(f.ready(d.where("yr >= 2000")), T.model_nodes(f.estimator, LAGS), LAGS, ["row_id"])


@query("attribution_trees")
def _(t):
    """Importance by exact Shapley values of a forest."""
    return A.global_importance(_tree_attributions(t, trees=10))


@query("attribution_trees_checks", "select 'forest' as learner, count(*) as rows, 0::bigint as violations from model_rows where yr >= 2000 union all select 'boosted', count(*), 0 from model_rows where yr >= 2000")
def _(t):
    """Base value and contributions add up to the prediction within 1e-9, for bagged and for boosted trees."""
    out = None
    for learner, kw in (("forest", {"trees": 10}), ("boosted", {"rounds": 5, "depth": 3})):
        per = _tree_attributions(t, learner, **kw).groupBy("row_id").agg(F.abs(F.max("base_value") + F.sum("shap") - F.max("prediction")).alias("gap"))
        one = per.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("gap") > 1e-9).alias("violations")).select(F.lit(learner).alias("learner"), "rows", "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("attribution_path_table", """with n as (select count(*) as c, count(*) filter (prev_value <= 150) as l, count(*) filter (prev_value <= 150 and gap_days <= 400) as ll,
        count(*) filter (prev_value > 150 or prev_value is null) as r, count(*) filter ((prev_value > 150 or prev_value is null) and density <= 1) as rl from model_rows where yr <= 1998),
    v as (select row_id, prev_value, gap_days, density, case when prev_value <= 150 then 1e0 else 0e0 end as p1, l / c::double as p0, case when gap_days <= 400 then 10e0 else 20e0 end as l1, (10e0 * ll + 20e0 * (l - ll)) / l as l0,
        case when density <= 1 then 40e0 else 80e0 end as r1, (40e0 * rl + 80e0 * (r - rl)) / r as r0 from model_rows, n where yr >= 2000),
    w as (select *, p0 * l0 + (1 - p0) * r0 as base_value, p1 * l1 + (1 - p1) * r1 as prediction from v)
    select row_id, base_value, prediction, 'prev_value' as feature, prev_value as feature_value, (p1 - p0) * ((l0 + l1) / 2 - (r0 + r1) / 2) as shap from w
    union all select row_id, base_value, prediction, 'gap_days', gap_days, (l1 - l0) * (p0 + p1) / 2 from w
    union all select row_id, base_value, prediction, 'density', density, (r1 - r0) * (1 - (p0 + p1) / 2) from w""", "base_value prediction feature_value shap")
def _(t):
    """A tree of three tests whose covers are counted from the older rows, against the closed form of its Shapley values."""
    d = durable(t.model_rows.select("row_id", "yr", "prev_value", "gap_days", "density"), "rows")
    low = F.coalesce(F.col("prev_value") <= 150, F.lit(False))
    near, thin = F.coalesce(F.col("gap_days") <= 400, F.lit(False)), F.coalesce(F.col("density") <= 1, F.lit(False))
    c = d.where("yr <= 1998").agg(F.count(F.lit(1)).alias("c"), F.count_if(low).alias("l"), F.count_if(low & near).alias("ll"), F.count_if(~low).alias("r"), F.count_if(~low & thin).alias("rl"))
    node = lambda i, left, right, feature, at, cover, value: F.struct(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), F.lit(i).alias("node"), F.lit(left).cast("int").alias("left"), F.lit(right).cast("int").alias("right"),
        F.lit(feature).cast("string").alias("feature"), F.lit(at).cast("double").alias("threshold"), F.expr(cover).cast("double").alias("cover"), F.lit(value).alias("value"))
    nodes = c.select(F.inline(F.array(node(0, 1, 2, "prev_value", 150, "c", 0.0), node(1, 3, 4, "gap_days", 400, "l", 0.0), node(2, 5, 6, "density", 1, "r", 0.0), node(3, None, None, None, None, "ll", 10.0),
                                              node(4, None, None, None, None, "l - ll", 20.0), node(5, None, None, None, None, "rl", 40.0), node(6, None, None, None, None, "r - rl", 80.0))))
    return T.attributions(d.where("yr >= 2000"), nodes, ["prev_value", "gap_days", "density"], ["row_id"])
