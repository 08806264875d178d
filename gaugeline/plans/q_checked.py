"""Gates counted while a table is written, gates on planted faults, corrections to history, quarantine of bad input."""

from pyspark.sql import functions as F

from gaugeline.operators import clusters as K
from gaugeline.operators import corrections as X
from gaugeline.operators import gates as G
from gaugeline.operators import history as H
from gaugeline.operators import splits as S
from gaugeline.operators.select import assign_temporal_split
from gaugeline.plans import q_fusion
from gaugeline.plans.registry import query
from gaugeline.session import durable, scratch_path
from gaugeline.sources import readers as R

ROW_GATES = ["gap_positive", "cold_start_nulls", "warm_has_previous", "history_bounds", "density_bounds", "flag_order", "climate_prior_year", "cutoff_before_date",
             "weights_sum_to_one", "empty_block_weight_zero", "weights_in_unit_interval", "availability_in_unit_interval"]
names = lambda gates: "[" + ", ".join(f"'{g}'" for g in gates) + "]"


def _weighted(t):
    """Model rows with their block weights and a cutoff column: what a benchmark's input table holds."""
    m = durable(t.model_rows, "model-rows")
    weights = q_fusion.U.FusionFit.fit(m.where("yr <= 1998")).transform(m, "C2").select("row_id", *[f"{k}_{b}" for b in "abcd" for k in ("w", "avail")])
    return m.join(weights, "row_id").withColumn("cutoff", F.date_sub("ts", 1))


def _checks(columns):
    return G.history_checks() + G.covariate_checks(columns) + G.weight_checks()


@query("gates_on_write", f"select g as gate, 0::bigint as violations, (select count(*) from model_rows) as rows from (select unnest({names(ROW_GATES)}) as g)")
def _(t):
    """Twelve row gates counted by the job that writes the fused table."""
    d, path = _weighted(t), scratch_path(t.spark, "fused")
    rep = G.write_checked(d, path, _checks(d.columns))
    n = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))                       # one row
    return rep.crossJoin(F.broadcast(n))


#: Faults by row id modulo 12: (gate, column, value that breaks it, rows on which it then counts).
FAULTS = [("gap_positive", "gap_days", "-gap_days", "gap_days is not null"), ("cold_start_nulls", "hist_mean", "coalesce(hist_mean, 1e0)", "prior_count = 0"), ("warm_has_previous", "prev_value", "null", "prior_count > 0"),
          ("history_bounds", "hist_min", "prev_value + 1", "prev_value is not null"), ("density_bounds", "density", "-1e0", "true"), ("flag_order", "very_long_gap", "long_gap + 1", "true"), ("climate_prior_year", "climate_year", "yr", "true"),
          ("cutoff_before_date", "cutoff", "ts", "true"), ("weights_sum_to_one", "w_a", "w_a + 0.5e0", "true"), ("empty_block_weight_zero", "w_d", "0.25e0", "true"), ("weights_in_unit_interval", "w_b", "-0.5e0", "true"),
          ("availability_in_unit_interval", "avail_c", "2e0", "true")]


@query("gates_on_write_faults", " union all ".join(f"select '{g}' as gate, count(*) filter (row_id % 12 = {i} and {c}) " + ("+ count(*) filter (row_id % 12 in (9, 10))" if g == "weights_sum_to_one" else "") + " as violations from model_rows" for i, (g, _, _, c) in enumerate(FAULTS)))
def _(t):
    """The same write with a fault of every kind planted: each gate counts exactly its own rows."""
    d = _weighted(t)
    bad = d
    for i, (_, column, value, _) in enumerate(FAULTS):
        kind = d.schema[column].dataType
        bad = bad.withColumn(column, F.when(F.col("row_id") % 12 == i, F.expr(value).cast(kind)).otherwise(F.col(column)))
    return G.write_checked(bad, scratch_path(t.spark, "fused"), _checks(d.columns))


@query("gates_splits_and_lags", "select unnest(['calibration_test_disjoint', 'parts_filled', 'cluster_isolation', 'second_lag_matches']) as gate, 0::bigint as violations")
def _(t):
    split = S.split_repeated(t.readings, [42])
    return (G.partition_gates(split).unionByName(G.cluster_gates(t.readings.select("entity_id").join(K.kmeans(t.sites), "entity_id")))
            .unionByName(G.second_lag_gates(t.history, t.readings)))


ALL_FAULTS = ["target_absent", "banned_absent", "features_present", "previous_date_exists", "previous_value_matches", "nothing_in_between", "same_date_consistent", "entity_overlap", "temporal_order",
              "rows_conserved", "key_frequency_conserved", "same_test_rows", "deterministic", "calibration_test_disjoint", "parts_filled", "cluster_isolation", "second_lag_matches", "bounds_ordered", "bounds_nested"]


@query("gates_table_faults", f"select unnest({names(ALL_FAULTS)}) as gate, 1::bigint as fired")
def _(t):
    """Gates that look at whole tables, each on a table that breaks it."""
    h = durable(t.history, "history")
    hit = F.col("row_id") % 10 == 0
    r = t.readings
    shifted = h.withColumn("gap_days", F.when(hit, F.col("gap_days") + 1).otherwise(F.col("gap_days")))
    valued = h.withColumn("prev_value", F.when(hit, F.col("prev_value") + 1).otherwise(F.col("prev_value")))
    lagged = h.withColumn("prev2_value", F.when(hit, F.col("prev2_value") + 1).otherwise(F.col("prev2_value")))
    day = h.groupBy("entity_id", "ts").agg(F.max("gap_days").alias("g1"))
    before = day.select("entity_id", F.col("ts").alias("pt"), F.col("g1").alias("g2"))
    skipped = day.withColumn("pt", F.date_sub("ts", F.col("g1").cast("int"))).join(before, ["entity_id", "pt"]).where("g2 is not null")
    skipped = h.drop("gap_days").join(skipped.select("entity_id", "ts", (F.col("g1") + F.col("g2")).alias("gap_days")), ["entity_id", "ts"])      # claims the reading before the last
    split = S.split_repeated(r, [42])
    leaked = split.unionByName(split.where("split = 'test'").withColumn("split", F.lit("calibration")))
    years = assign_temporal_split(r, 1998, 1999).withColumn("split", F.when(hit, F.lit("test")).otherwise(F.col("split")))
    places = r.select("entity_id", (F.col("row_id") % 2).alias("cluster"))
    bands = r.select(F.col("value").alias("lower_90"), (F.col("value") - 1).alias("upper_90"), F.col("value").alias("lower_95"), (F.col("value") - 2).alias("upper_95"))
    some = lambda part, *gates: part.where(F.col("gate").isin(*gates))
    parts = [G.schema_gates(h, ["value", "raster_value", "absent"], "value"), some(G.fidelity_gates(shifted, r), "previous_date_exists"), some(G.fidelity_gates(valued, r), "previous_value_matches"), some(G.fidelity_gates(skipped, r), "nothing_in_between"),
             some(G.fidelity_gates(h.unionByName(h.where(hit).withColumn("prev_value", F.col("prev_value") + 1)), r), "same_date_consistent"), G.split_gates(leaked, keys=["seed"]), G.temporal_gate(years),
             G.conservation_gates(r, h.where(~hit), ["entity_id", "ts"]), G.same_rows_gate(t.seeded_log.where("not (config = 'base' and row_id % 10 = 0)")), G.determinism_gate(h, valued, ["row_id", "prev_value"]),
             G.partition_gates(leaked.where("split <> 'train'")), G.cluster_gates(places), G.second_lag_gates(lagged, r), G.interval_gates(bands)]
    return G.report(parts).groupBy("gate").agg(F.max(F.when(F.col("violations") > 0, 1).otherwise(0)).cast("bigint").alias("fired"))


@query("gates_determinism", "select 'deterministic' as gate, 0::bigint as violations")
def _(t):
    """Two builds of the history from different layouts of the readings: a written copy in other files and another order."""
    again = durable(t.readings.repartition(13, "row_id").sortWithinPartitions(F.desc("ts")), "readings")
    return G.determinism_gate(durable(t.history, "once"), durable(H.history_features(again), "twice"), ["row_id", "prev_value", "prior_count", "gap_days", "long_gap"])


# corrections -----------------------------------------------------------------------------------------------------------

LATE, CHANGED, DELETED, MOVED = "row_id % 97 = 0", "row_id % 89 = 1", "row_id % 83 = 2", "row_id % 79 = 3"


def _corrections(t):
    """The readings as they once were, and the days that differ from now."""
    now = t.readings.select("row_id", "entity_id", "ts", "value")
    moved = F.when(F.expr(MOVED), F.date_add("ts", 1)).otherwise(F.col("ts"))
    was = now.where(f"not ({LATE})").withColumn("value", F.when(F.expr(CHANGED), F.col("value") + 7).otherwise(F.col("value"))).withColumn("ts", moved)
    gone = now.where(DELETED).withColumns({"row_id": -F.col("row_id"), "ts": F.date_add("ts", 5)})
    old = was.unionByName(gone)
    touched = X.touched_days(now.where(f"{LATE} or {CHANGED} or {MOVED}"), was.where(f"{CHANGED} or {MOVED}"), gone)
    return durable(X.day_state(old), "state"), now, durable(touched, "touched")


@query("history_corrections", "select * exclude (prev_ts) from day_hist", "prev_value prev2_value gap_days gap_years roll3_mean roll3_std prev_change recent_trend hist_mean hist_std hist_min hist_max density", digits=5)
def _(t):
    """Late, changed, moved and deleted readings carried into the stored history: equal to a full rebuild."""
    return X.corrected(*_corrections(t)).drop("day_mean", "day_rows", "hist_n")


@query("history_corrections_cost", f"""with m as (select entity_id, row_id, ts from readings), was as (select entity_id, row_id, case when {MOVED} then ts + 1 else ts end as ts from m where not ({LATE})),
       touched as (select entity_id, ts from m where {LATE} or {CHANGED} or {MOVED} union select entity_id, ts from was where {CHANGED} or {MOVED} union select entity_id, ts + 5 from m where {DELETED}),
       since as (select entity_id, min(ts) as t0 from touched group by 1)
       select count(*) filter (d.ts >= s.t0) as rewritten, count(*) as days from days d left join since s using (entity_id)""")
def _(t):
    """Rows rewritten, of all: those of touched entities from their first touched day on."""
    state, now, touched = _corrections(t)
    new = X.rebuilt(state, now, touched).agg(F.count(F.lit(1)).alias("rewritten"))
    days = H.day_table(now).agg(F.count(F.lit(1)).alias("days"))
    return new.crossJoin(F.broadcast(days))                                                   # one row each


# quarantine ------------------------------------------------------------------------------------------------------------

LINE_DDL = "row_id bigint, entity_id bigint, ts date, value double, season string"


def _csv(t):
    path = scratch_path(t.spark, "csv")
    k = F.col("row_id") % 40
    ts = F.when(k == 1, F.lit("1997-13-45")).otherwise(F.col("ts").cast("string"))
    value = F.when(k == 2, F.lit("n/a")).when(k == 3, F.lit("")).otherwise(F.col("value").cast("string"))
    season = F.concat(F.lit('"'), F.coalesce("season", F.lit("")), F.when(k == 4, F.lit(", late")).otherwise(F.lit("")), F.lit('"'))
    line = F.concat_ws(",", F.col("row_id").cast("string"), F.when(k == 1, F.lit("x7")).otherwise(F.col("entity_id").cast("string")), ts, value, season)
    line = F.when(k == 5, F.substring_index(line, ",", 3)).when(k == 6, F.concat(line, F.lit(",extra,more"))).otherwise(line)
    body = t.readings.select(line.alias("value"))
    body.unionByName(t.spark.range(1).select(F.lit("row_id,entity_id,ts,value,season").alias("value"))).write.text(path)
    return R.scan_csv_quarantine(t.spark, path, LINE_DDL)


@query("scan_csv_quarantine", """select row_id, case when row_id % 40 <> 1 then entity_id end as entity_id, case when row_id % 40 <> 1 then ts end as ts, case when row_id % 40 not in (2, 3) then value end as value,
       case when row_id % 40 = 4 then coalesce(season, '') || ', late' else season end as season from readings where row_id % 40 not in (5, 6)""", "value")
def _(t):
    """Rows of a CSV in which lines and cells are broken: broken cells are null, broken lines are away."""
    rows = _csv(t)[0]
    return rows.withColumn("season", F.when(F.col("season") != "", F.trim("season")))


@query("scan_csv_quarantine_report", """select 'number of fields' as reason, null as "column", count(*) as n, count(*) as lines from readings where row_id % 40 in (5, 6) having count(*) > 0
       union all select 'not a bigint', 'entity_id', count(*), count(*) from readings where row_id % 40 = 1 having count(*) > 0
       union all select 'not a date', 'ts', count(*), count(*) from readings where row_id % 40 = 1 having count(*) > 0
       union all select 'not a double', 'value', count(*), count(*) from readings where row_id % 40 = 2 having count(*) > 0""")
def _(t):
    return _csv(t)[1].groupBy("reason", "column").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("lines"))


@query("scan_csv_quarantine_balance", "select count(*) as lines, count(*) filter (row_id % 40 not in (5, 6)) as good, count(*) filter (row_id % 40 in (5, 6)) as bad from readings")
def _(t):
    """Good rows and quarantined lines add up to all lines."""
    rows, bad = _csv(t)
    good, away = rows.agg(F.count(F.lit(1)).alias("good")), bad.where(F.col("column").isNull()).agg(F.count(F.lit(1)).alias("bad"))
    return good.crossJoin(F.broadcast(away)).select((F.col("good") + F.col("bad")).alias("lines"), "good", "bad")
