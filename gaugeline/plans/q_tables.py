"""Sources, filters, joins, set operations and ordered reports."""

from pyspark.sql import functions as F

from gaugeline.config import BLOCKS
from gaugeline.functions import scalars as S
from gaugeline.operators import lookup as L
from gaugeline.operators import ordered
from gaugeline.operators import select as P
from gaugeline.plans.registry import query
from gaugeline.sources import readers as R

READ_COLS = "row_id, entity_id, ts, yr::bigint as yr, value, season"


@query("scan_csv", f"select {READ_COLS} from readings", "value")
def _(t):
    path = R.scratch_path(t.spark, "csv")
    R.write_table(t.readings, path, fmt="csv")
    return R.scan_csv(t.spark, path, "row_id bigint, entity_id bigint, ts date, yr int, value double, season string")


@query("scan_csv_preamble", """select cast(year(ts) as bigint) as "YEAR", cast(dayofyear(ts) as bigint) as "DOY", ts, temp as "T2M",
       precip as "PRECTOTCORR", solar as "SOLAR" from daily_raw""", '"T2M" "PRECTOTCORR" "SOLAR"')
def _(t):
    path = R.scratch_path(t.spark, "preamble")
    body = t.daily_raw.select(F.concat_ws(",", F.year("ts"), F.dayofyear("ts"), "temp", "precip", "solar").alias("value"))
    head = t.daily_raw.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.array(
        F.lit("-BEGIN HEADER-"), F.concat(F.lit("Dates (month/day/year): "), F.date_format("a", "MM/dd/yyyy"), F.lit(" through "),
                                          F.date_format("b", "MM/dd/yyyy")),
        F.lit("The value for missing source data is: -999"), F.lit("-END HEADER-"),
        F.lit("YEAR,DOY,T2M,PRECTOTCORR,SOLAR"))).alias("value"))
    head.unionByName(body).write.text(path)
    d = R.scan_csv_preamble(t.spark, path, "YEAR int, DOY int, T2M double, PRECTOTCORR double, SOLAR double")
    return d.withColumn("ts", R.year_doy_to_date("YEAR", "DOY"))


@query("year_doy_to_date", "select ts, ts as rebuilt from daily_raw")
def _(t):
    d = t.daily_raw.select("ts", F.year("ts").alias("y"), F.dayofyear("ts").alias("d"))
    return d.select("ts", R.year_doy_to_date("y", "d").alias("rebuilt"))


@query("coerce_numeric", """select event_id, try_cast(case when event_id % 5 = 0 then event_type else cast(value as varchar) end as double) as v from events""", "v")
def _(t):
    d = t.raw("events").select("event_id", F.expr("case when event_id % 5 = 0 then event_type else cast(value as string) end").alias("v"))
    return R.coerce_numeric(d, ["v"])


@query("coerce_date", """select row_id, case when row_id % 7 = 0 then null else ts end as d from readings""")
def _(t):
    d = t.readings.select("row_id", F.expr("case when row_id % 7 = 0 then 'n/a ' || season else cast(ts as string) end").alias("d"))
    return R.coerce_date(d, ["d"])


@query("purge_leakage_columns", "select row_id, entity_id, value from readings", "value")
def _(t):
    d = t.readings.select("row_id", "entity_id", "value", (F.col("value") * 2).alias("Raster_Value"), F.lit(1.0).alias("dem_elevation"))
    return R.reject_banned(R.require_columns(R.purge_banned(d), ["row_id", "entity_id", "value"]))


@query("scan_raster_cells", "select yr::bigint as yr, r::bigint as r, c::bigint as c, cell from raster", "cell")
def _(t):
    root = R.scratch_path(t.spark, "raster")
    d = t.raster.withColumn("part", F.concat(F.lit("Groundwater_"), F.col("yr").cast("string"))).drop("yr")
    R.write_table(d, root, partition_by=["part"])
    return R.scan_raster_cells(t.spark, root).select("yr", "r", "c", "cell")


@query("write_json_payload", """select county, count(*) as n, string_agg(entity_id::varchar, ',' order by entity_id) as ids from (
       select county, entity_id, row_number() over (partition by county order by entity_id) as k from sites) where k <= 5 group by county""")
def _(t):
    path = R.scratch_path(t.spark, "json")
    top = ordered.top_k_per_group(t.sites, 5, ["entity_id"], ["county"], "k")
    nested = top.groupBy("county").agg(F.array_sort(F.collect_list(F.struct("k", "entity_id", "lat"))).alias("items"))
    R.write_json_payload(nested, path)
    back = R.read_json_payload(t.spark, path, "county string, items array<struct<k:int,entity_id:bigint,lat:double>>")
    ids = F.concat_ws(",", F.transform("items", lambda x: x["entity_id"].cast("string")))
    return back.select("county", F.size("items").alias("n"), ids.alias("ids"))


@query("write_table", "select yr::bigint as yr, count(*) as n, sum(value) as total from readings group by yr", "total")
def _(t):
    path = R.scratch_path(t.spark, "table")
    R.write_table(t.readings, path, partition_by=["yr"])
    back = t.spark.read.parquet(R.first_existing(t.spark, [path + "-absent", path]))
    return back.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("entity_tables", """select county, count(*) as n, min(entity_id) as first_id, max(lat) as max_lat, max(elev) as max_elev
       from sites group by county""", "max_lat max_elev")
def _(t):
    """Create a fixed-schema entity table, append a second batch, list all."""
    path = R.scratch_path(t.spark, "sites")
    typed = t.sites.selectExpr("entity_id", "county", "cast(lat as decimal(10,7)) as lat", "cast(lon as decimal(10,7)) as lon",
                               "cast(elev as decimal(10,3)) as elev")
    R.append_rows(typed.where("entity_id % 2 = 0"), path)
    R.append_rows(typed.where("entity_id % 2 = 1"), path)
    return t.spark.read.parquet(path).groupBy("county").agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id"), F.max("lat").cast("double").alias("max_lat"),
        F.max("elev").cast("double").alias("max_elev"))


@query("select_features", "select row_id, prev_value, roll3_mean, density from hist", "prev_value roll3_mean density")
def _(t):
    return P.select_features(t.history, ["prev_value", "no_such_feature", "roll3_mean", "density"], keep=["row_id"])


@query("harmonize_columns", """select row_id, model, y_true as actual, y_pred as predicted, y_pred - y_true as error,
       abs(y_pred - y_true) as abs_error from predictions""", "actual predicted error abs_error")
def _(t):
    return P.harmonize_columns(t.predictions.drop("entity_id", "ts", "yr"))


@query("drop_incomplete", "select row_id, prev2_value, season from hist where prev2_value is not null and season is not null", "prev2_value")
def _(t):
    return P.drop_incomplete(t.history, ["prev2_value", "season"]).select("row_id", "prev2_value", "season")


@query("incomplete_report", """select count(*) as rows_in, count(*) filter (prev2_value is not null and season is not null) as rows_kept,
       count(*) filter (prev2_value is null or season is null) as rows_dropped from hist""")
def _(t):
    return P.incomplete_report(t.history, ["prev2_value", "season"])


@query("filter_range", "select row_id, yr::bigint as yr, value from readings where yr >= 1996 and yr <= 1998", "value")
def _(t):
    return P.filter_range(t.readings, "yr", 1996, 1998).select("row_id", "yr", "value")


@query("filter_membership", """select row_id, entity_id from readings where entity_id in (select entity_id from sites where county = 'NATION_3')""")
def _(t):
    return P.filter_membership(t.readings, t.sites.where("county = 'NATION_3'"), "entity_id").select("row_id", "entity_id")


@query("filter_null_rows", "select row_id, entity_id from readings where season is null")
def _(t):
    return P.filter_null_rows(t.readings, "season").select("row_id", "entity_id")


@query("filter_finite", "select yr::bigint as yr, r::bigint as r, c::bigint as c, cell from raster where cell is not null and (r + c) % 11 <> 0", "cell")
def _(t):
    d = t.raster.withColumn("cell", F.expr("case when (r + c) % 11 = 0 then double('NaN') else cell end"))
    return P.filter_finite(d, "cell")


@query("sample_rows", "select row_id, value from readings order by md5(row_id::varchar || '_42'), row_id limit 1000", "value")
def _(t):
    return P.sample_rows(t.readings, 1000, "row_id", 42).select("row_id", "value")


@query("filter_by_category", "select row_id, season from readings where lower(season) = '1-urgent'")
def _(t):
    return P.filter_by_category(t.readings, "season", "1-URGENT").select("row_id", "season")


@query("search_substring", """select entity_id, county from sites where contains(lower(county), 'tion_1') or contains(entity_id::varchar, 'tion_1')""")
def _(t):
    return P.search_substring(t.sites, ["entity_id", "county"], "TION_1").select("entity_id", "county")


@query("lookup_by_id", "select entity_id, county, lat, lon from sites where entity_id = 17", "lat lon")
def _(t):
    return P.lookup_by_id(t.sites, "entity_id", " 17 ").select("entity_id", "county", "lat", "lon")


@query("assign_temporal_split", """select split, count(*) as n, min(yr)::bigint as first_year, max(yr)::bigint as last_year from
       (select *, case when yr <= 1998 then 'train' when yr <= 1999 then 'validation' else 'test' end as split from readings) group by split""")
def _(t):
    return P.assign_temporal_split(t.readings, 1998, 1999).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"))


_present = [(b, c) for b in "abc" for c in BLOCKS[b]]


@query("feature_catalog", " union all ".join(
    f"""select '{c}' as feature, '{b}' as block, '{ {'a': 'earlier readings', 'b': 'previous year', 'c': 'static'}[b] }' as known_from,
    count(*) filter ({c} is null and prior_count > 0) as missing_warm, count(*) filter ({c} is null and prior_count = 0) as missing_cold
    from model_rows""" for b, c in _present))
def _(t):
    return P.feature_catalog(t.model_rows, BLOCKS)


@query("depth_class", """select row_id, case when prior_count = 0 then 'cold_start' when prev_value < 30 then 'shallow'
       when prev_value <= 100 then 'intermediate' else 'deep' end as depth_class from hist""")
def _(t):
    return t.history.select("row_id", P.depth_class().alias("depth_class"))


@query("clean_float_default", """select event_id, coalesce(case when isfinite(v) then v end, 45e0) as v from (select event_id,
       case when event_id % 5 = 0 then null when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then null else value end as v
       from events)""", "v")
def _(t):
    d = t.raw("events").select("event_id", F.expr("""case when event_id % 5 = 0 then 'bad' when event_id % 7 = 0 then 'NaN'
        when event_id % 11 = 0 then null else cast(value as string) end""").alias("raw"))
    return d.select("event_id", S.clean_float("raw", 45.0).alias("v"))


@query("binary_availability", """select row_id, case when temp_mean is not null and precip_total is not null and rh_mean is not null and
       wind_mean is not null and solar_mean is not null then 1e0 else 0e0 end as has_climate, case when prev2_value is not null and
       roll3_std is not null then 1e0 else 0e0 end as has_lags from model_rows""", "has_climate has_lags")
def _(t):
    d = P.binary_availability(t.model_rows, BLOCKS["b"], "has_climate")
    return P.binary_availability(d, ["prev2_value", "roll3_std"], "has_lags").select("row_id", "has_climate", "has_lags")


# joins ---------------------------------------------------------------------------------------------------------------

@query("join_entity_year", """select r.row_id, r.yr::bigint as yr, (select b.value from readings b where b.entity_id = r.entity_id and b.yr = r.yr + 1
       order by b.ts, b.row_id limit 1) as next_year_first from readings r""", "next_year_first")
def _(t):
    y = t.readings.selectExpr("entity_id", "yr - 1 as yr", "ts as y_ts", "row_id as y_row", "value as next_year_first")
    return L.join_entity_year(t.readings, y, ["y_ts", "y_row"]).select("row_id", "yr", "next_year_first")


TARGET_YEARS = (1995, 1997, 1999, 2001)


@query("asof_nearest_year", f"""select entity_id, target_year, level, dist as year_distance from (
       select e.entity_id, y.target_year, r.value as level, abs(r.yr - y.target_year)::bigint as dist,
       row_number() over (partition by e.entity_id, y.target_year order by abs(r.yr - y.target_year), r.yr,
       case when r.yr = y.target_year then -1 else 1 end * epoch(r.ts), case when r.yr = y.target_year then -r.row_id else r.row_id end) as n
       from (select distinct entity_id from readings) e cross join (select unnest([{', '.join(map(str, TARGET_YEARS))}])::bigint as target_year) y
       join readings r on r.entity_id = e.entity_id) where n = 1""", "level")
def _(t):
    years = t.spark.range(1).select(F.explode(F.array(*[F.lit(y) for y in TARGET_YEARS])).alias("target_year"))
    return L.asof_nearest_year(years, t.readings)


@query("anti_join_rows", """select 'only_in_full' as side, row_id, season from readings where row_id % 50 = 0
       union all select 'only_in_clean', row_id, coalesce(season, 'x') from readings where row_id % 77 = 0 and row_id % 50 <> 0
       union all select 'only_in_full', row_id, season from readings where row_id % 77 = 0 and row_id % 50 <> 0""")
def _(t):
    full = t.readings
    clean = full.where("row_id % 50 <> 0").withColumn("season", F.expr(
        "case when row_id % 77 = 0 then coalesce(season, 'x') else season end")).withColumn("value", F.expr(
            "case when row_id % 77 = 0 then value + 1 else value end"))
    cols = ["row_id", "entity_id", "ts", "yr", "value", "season"]
    a = L.anti_join_rows(full, clean, cols).select(F.lit("only_in_full").alias("side"), "row_id", "season")
    b = L.anti_join_rows(clean, full, cols).select(F.lit("only_in_clean").alias("side"), "row_id", "season")
    return a.unionByName(b)


@query("semi_join_duplicates", """select row_id, entity_id, ts from readings r where (select count(*) from readings b
       where b.entity_id = r.entity_id and b.ts = r.ts) > 1""")
def _(t):
    return L.semi_join_duplicates(t.readings, ["entity_id", "ts"]).select("row_id", "entity_id", "ts")


@query("recover_attribute", """select r.row_id, (select b.season from readings b where b.entity_id = r.entity_id and b.ts = r.ts
       and b.value = r.value order by b.row_id limit 1) as season from readings r""")
def _(t):
    return L.recover_attribute(t.readings.drop("season"), t.readings, ["entity_id", "ts", "value"], "season", ["row_id"]).select("row_id", "season")


@query("join_observation_count", """select p.row_id, p.model, c.n as observation_count from predictions p
       join (select entity_id, count(*) as n from readings group by 1) c using (entity_id)""")
def _(t):
    return L.join_observation_count(t.predictions, t.readings).select("row_id", "model", "observation_count")


_RUN = """select seed, config, sqrt(avg(pow(y_pred - y_true, 2))) as rmse, avg(abs(y_pred - y_true)) as mae from slog"""


@query("paired_run_join", f"""with a as ({_RUN} group by all), b as ({_RUN} where row_id % 400 <> 0 group by all)
       select seed::bigint as seed, config, abs(a.rmse - b.rmse) as rmse_diff, abs(a.mae - b.mae) as mae_diff,
       greatest(abs(a.rmse - b.rmse), abs(a.mae - b.mae)) as max_diff,
       case when greatest(abs(a.rmse - b.rmse), abs(a.mae - b.mae)) < 0.02 then 1::bigint else 0::bigint end as passed
       from a join b using (seed, config)""", "rmse_diff mae_diff max_diff")
def _(t):
    def run(d):
        return d.groupBy("seed", "config").agg(F.sqrt(F.avg(F.expr("(y_pred - y_true) * (y_pred - y_true)"))).alias("rmse"),
                                               F.avg(F.expr("abs(y_pred - y_true)")).alias("mae"))
    return L.paired_run_join(run(t.seeded_log), run(t.seeded_log.where("row_id % 400 <> 0")), ["seed", "config"], ["rmse", "mae"], 0.02)


# set operations -------------------------------------------------------------------------------------------------------

@query("common_years", "select distinct yr::bigint as yr from readings where yr in (select yr from annual)")
def _(t):
    return L.common_values(t.readings, t.annual, "yr")


@query("missing_years", """select e.entity_id, y as missing_year from (select entity_id, min(yr) as a, max(yr) as b from readings group by 1) e,
       unnest(range(a::bigint, b::bigint + 1)) as u(y) where not exists (select 1 from readings r where r.entity_id = e.entity_id and r.yr = y)""")
def _(t):
    return L.missing_years(t.readings)


@query("union_results", """select 'level' as experiment, model, count(*) as n, avg(abs(y_pred - y_true)) as mae, cast(null as double) as bias from predictions group by model
       union all select 'signed', model, count(*), null, avg(y_pred - y_true) from predictions group by model""", "mae bias")
def _(t):
    p = t.predictions
    a = p.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("abs(y_pred - y_true)")).alias("mae")).withColumn("experiment", F.lit("level"))
    b = p.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr("y_pred - y_true")).alias("bias")).withColumn("experiment", F.lit("signed"))
    return L.union_results([a, b])


@query("unique_in_order", """select row_id, array_to_string(list_distinct_in_order, ',') as parts from (select row_id,
       list_transform(list_filter(list_zip([a,b,c], [1,2,3]), lambda x: x[2] = list_position([a,b,c], x[1])), lambda x: x[1]) as list_distinct_in_order
       from (select row_id, (row_id % 2)::varchar as a, (row_id % 3)::varchar as b, (row_id % 5)::varchar as c from readings))""")
def _(t):
    arr = F.array(*[(F.col("row_id") % k).cast("string") for k in (2, 3, 5)])
    return t.readings.select("row_id", arr.alias("a")).select("row_id", F.concat_ws(",", P.unique_in_order("a")).alias("parts"))


# ordered reports ------------------------------------------------------------------------------------------------------

@query("worst_predictions", """select model, row_id, abs_error, rank from (select model, row_id, abs(y_pred - y_true) as abs_error,
       row_number() over (partition by model order by abs(y_pred - y_true) desc, row_id) as rank from predictions) where rank <= 20""", "abs_error")
def _(t):
    d = t.predictions.select("model", "row_id", F.abs(F.col("y_pred") - F.col("y_true")).alias("abs_error"))
    return ordered.top_k_per_group(d, 20, [F.desc("abs_error"), "row_id"], ["model"])


@query("top_covered_entities", """select entity_id, max(yr)::bigint - min(yr) + 1 as span_years, count(*) as n from readings group by 1
       order by span_years desc, n desc, entity_id limit 20""")
def _(t):
    d = t.readings.groupBy("entity_id").agg((F.max("yr") - F.min("yr") + 1).alias("span_years"), F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("span_years"), F.desc("n"), "entity_id").limit(20)


@query("sort_multi_key", "select row_id, entity_id, yr::bigint as yr from readings order by yr, entity_id, row_id")
def _(t):
    return t.readings.select("row_id", "entity_id", "yr").orderBy("yr", "entity_id", "row_id")
