"""Window and ordered queries over readings and the daily series."""

from pyspark.sql import functions as F

from gaugeline.operators import history as H
from gaugeline.operators import ordered, weather
from gaugeline.plans.registry import query

FEATURES = ("prev_value prev2_value gap_days gap_years roll3_mean roll3_std prev_change recent_trend hist_mean hist_std "
            "hist_min hist_max density")


def _days(t):
    return H.day_table(t.readings)


@query("history_features", f"""select row_id, entity_id, ts, value, {', '.join(FEATURES.split())}, prior_count,
       long_gap, very_long_gap from hist""", "value " + FEATURES)
def _(t):
    return t.history.select("row_id", "entity_id", "ts", "value", *FEATURES.split(), "prior_count", "long_gap", "very_long_gap")


@query("prior_levels", "select entity_id, ts, prev_value, prev2_value from day_hist", "prev_value prev2_value")
def _(t):
    return H.prior_levels(_days(t)).select("entity_id", "ts", "prev_value", "prev2_value")


@query("gap_since_previous", "select entity_id, ts, gap_days, gap_years from day_hist", "gap_days gap_years")
def _(t):
    return H.gap_since_previous(_days(t)).select("entity_id", "ts", "gap_days", "gap_years")


@query("rolling_last3", "select entity_id, ts, roll3_mean, roll3_std from day_hist", "roll3_mean roll3_std")
def _(t):
    return H.rolling_last3(_days(t)).select("entity_id", "ts", "roll3_mean", "roll3_std")


@query("level_change_trend", "select entity_id, ts, prev_change, recent_trend from day_hist", "prev_change recent_trend")
def _(t):
    return H.level_change_trend(_days(t)).select("entity_id", "ts", "prev_change", "recent_trend")


@query("expanding_history", "select entity_id, ts, hist_mean, hist_std, hist_min, hist_max from day_hist",
       "hist_mean hist_std hist_min hist_max")
def _(t):
    return H.expanding_history(_days(t)).select("entity_id", "ts", "hist_mean", "hist_std", "hist_min", "hist_max")


@query("prior_row_count", """select a.row_id, (select count(*) from readings b where b.entity_id = a.entity_id
       and b.ts < a.ts) as prior_count from readings a""")
def _(t):
    d = H.prior_row_count(_days(t))
    return H.attach(t.readings, d).select("row_id", "prior_count")


@query("observation_density", """select a.row_id, (select count(*) from readings b where b.entity_id = a.entity_id
       and b.ts < a.ts and b.ts >= a.ts - interval 3 year) / 3e0 as density from readings a""", "density")
def _(t):
    return H.attach(t.readings, H.observation_density(_days(t))).select("row_id", "density")


@query("gap_flags", """select row_id, gap_days, case when gap_days > 730.5 then 1::bigint else 0::bigint end as long_gap,
       case when gap_days > 1095.75 then 1::bigint else 0::bigint end as very_long_gap from hist""", "gap_days")
def _(t):
    return H.gap_flags(H.attach(t.readings, H.gap_since_previous(_days(t)))).select(
        "row_id", "gap_days", "long_gap", "very_long_gap")


@query("row_lag_features", """
with o as (select *, row_number() over (partition by entity_id order by ts, row_id) as n from readings)
select a.row_id, b.value as lag1, c.value as lag2, cast(a.ts - b.ts as double) as gap_days, b.value - c.value as lag_change,
       a.n - 1 as prior_rows, case when a.n > 1 then (b.value + coalesce(c.value, 0) + coalesce(d.value, 0)) /
       least(a.n - 1, 3) end as roll3_rows_mean, case when a.ts - b.ts > 365 then 1::bigint else 0::bigint end as long_gap
from o a left join o b on b.entity_id = a.entity_id and b.n = a.n - 1 left join o c on c.entity_id = a.entity_id
     and c.n = a.n - 2 left join o d on d.entity_id = a.entity_id and d.n = a.n - 3""",
       "lag1 lag2 gap_days lag_change roll3_rows_mean")
def _(t):
    return H.row_lag_features(t.readings).select(
        "row_id", "lag1", "lag2", "gap_days", "lag_change", "prior_rows", "roll3_rows_mean", "long_gap")


@query("asof_prior_reading", """select a.row_id, (select avg(b.value) from readings b where b.entity_id = a.entity_id and b.ts =
       (select max(c.ts) from readings c where c.entity_id = a.entity_id and c.ts < a.ts)) as prev_value,
       h.prev2_value from readings a join (select entity_id, ts, prev2_value from day_hist) h using (entity_id, ts)""",
       "prev_value prev2_value")
def _(t):
    return H.attach(t.readings, H.prior_levels(_days(t))).select("row_id", "prev_value", "prev2_value")


@query("delta_target", "select row_id, prev_value - value as delta from hist", "delta")
def _(t):
    return H.delta_target(t.history).select("row_id", "delta")


WIN = [f"precip_{n}d" for n in (7, 14, 30, 60, 90, 180)] + [
    "rain_days_30d", "max_precip_30d", "temp_mean_30d", "temp_max_30d", "radiation_30d", "rh_mean_30d", "wind_mean_30d"]


@query("rolling_day_windows", f"select ts, {', '.join(WIN)} from windows", " ".join(WIN))
def _(t):
    return weather.rolling_day_windows(t.daily).select("ts", *WIN)


@query("dry_spell_streak", """select a.ts, cast(case when coalesce(a.precip < 1, false) then (select count(*) from daily b
       where b.ts <= a.ts and b.ts > coalesce((select max(c.ts) from daily c where c.ts <= a.ts and
       not coalesce(c.precip < 1, false)), date '0001-01-01')) else 0 end as double) as dry_spell_days from daily a""", "dry_spell_days")
def _(t):
    return weather.dry_spell_streak(t.daily).select("ts", "dry_spell_days")


@query("cumulative_sum", "select a.ts, (select sum(b.precip) from daily b where b.ts <= a.ts) as precip_cum from daily a", "precip_cum")
def _(t):
    return weather.cumulative_precip(t.daily).select("ts", "precip_cum")


@query("interval_sum_between_readings", """select row_id, precip_interval from response""", "precip_interval")
def _(t):
    d = weather.previous_date(t.readings)
    return weather.interval_sum_between_readings(d, t.daily).select("row_id", "precip_interval")


ALLWIN = WIN + ["dry_spell_days"]


@query("join_prior_day_windows", f"""select r.row_id, r.ts - 1 as cutoff, {', '.join('w.' + c for c in WIN)}, d.dry_spell_days
       from readings r left join windows w on w.ts = r.ts - 1 left join dry d on d.ts = r.ts - 1""", " ".join(ALLWIN))
def _(t):
    return weather.join_prior_day_windows(t.readings, t.windows).select("row_id", "cutoff", *ALLWIN)


# Several stations: the line numbers of `lineitem`; a reading belongs to station 1 + row_id % 7.
STATIONS = """(select l_linenumber::bigint as station, cast(l_shipdate as date) as ts, greatest(cast(sum(l_quantity) as bigint) % 10 - 5, 0) * 1e0 as precip,
       floor(sum(floor(l_extendedprice)) / count(*) / 800e0) / 4e0 as temp from lineitem group by 1, 2)"""


def _at_station(df):
    return df.withColumn("station", F.col("row_id") % 7 + 1)


@query("rolling_day_windows_by_station", f"""select station, ts, sum(precip) over (w range between interval 6 day preceding and current row) as precip_7d, sum(precip) over (w range between interval 179 day preceding and current row) as precip_180d,
       avg(temp) over (w range between interval 29 day preceding and current row) as temp_mean_30d from {STATIONS} window w as (partition by station order by ts)""", "precip_7d precip_180d temp_mean_30d")
def _(t):
    return weather.rolling_day_windows(t.station_daily, station="station").select("station", "ts", "precip_7d", "precip_180d", "temp_mean_30d")


@query("dry_spell_by_station", f"""select station, ts, cast(row_number() over (partition by station, wet order by ts) - case when wet > 0 then 1 else 0 end as double) as dry_spell_days from
       (select *, count(*) filter (not precip < 1) over (partition by station order by ts) as wet from {STATIONS})""", "dry_spell_days")
def _(t):
    return weather.dry_spell_streak(t.station_daily, station="station").select("station", "ts", "dry_spell_days")


@query("join_prior_day_windows_by_station", f"""with w as (select station, ts, sum(precip) over (partition by station order by ts range between interval 29 day preceding and current row) as precip_30d from {STATIONS})
       select r.row_id, r.ts - 1 as cutoff, w.precip_30d from readings r left join w on w.ts = r.ts - 1 and w.station = r.row_id % 7 + 1""", "precip_30d")
def _(t):
    return weather.join_prior_day_windows(_at_station(t.readings), weather.rolling_day_windows(t.station_daily, station="station"), ["precip_30d"], station="station").select("row_id", "cutoff", "precip_30d")


@query("annual_weather_by_station", f"select station, year(ts)::bigint as yr, avg(temp) as temp_mean, sum(precip) as precip_total from {STATIONS} group by 1, 2", "temp_mean precip_total")
def _(t):
    return weather.annual_weather(t.station_daily, station="station").select("station", "yr", "temp_mean", "precip_total")


@query("join_prior_year_by_station", f"""with a as (select station, year(ts) as yr, sum(precip) as precip_total from {STATIONS} group by 1, 2)
       select r.row_id, a.precip_total, case when a.yr is null then 0e0 else 1e0 end as climate_available from readings r left join a on a.station = r.row_id % 7 + 1 and a.yr = r.yr - 1""", "precip_total")
def _(t):
    """Last year's total of the reading's own station: not added up over stations."""
    annual = weather.annual_weather(t.station_daily, station="station")
    return weather.join_prior_year(_at_station(t.readings), annual, ["precip_total"], station="station").select("row_id", "precip_total", "climate_available")


@query("weather_coverage_by_station", f"""select station, count(*) as dates, count(d) as covered, 100e0 * count(d) / count(*) as covered_pct from (select distinct row_id % 7 + 1 as station, ts from readings) r
       left join (select distinct station, ts, 1 as d from {STATIONS}) s using (station, ts) group by 1""", "covered_pct")
def _(t):
    return weather.weather_coverage(_at_station(t.readings), t.station_daily, station="station")


@query("weather_audit_by_station", f"""select station, 'precip' as variable, count(*) as n, 0::bigint as nulls, min(precip) as v_min, median(precip) as v_median, max(precip) as v_max from {STATIONS} group by 1
       union all select station, 'temp', count(*), 0, min(temp), median(temp), max(temp) from {STATIONS} group by 1""", "v_min v_median v_max")
def _(t):
    return weather.weather_variable_audit(t.station_daily, ["precip", "temp"], station="station").select("station", "variable", "n", "nulls", "v_min", "v_median", "v_max")


@query("interval_sum_by_station", f"""with s as {STATIONS}, e as (select station, min(ts) as a, max(ts) as b from s group by 1),
       p as (select r.row_id, r.row_id % 7 + 1 as station, r.ts, (select max(q.ts) from readings q where q.entity_id = r.entity_id and q.ts < r.ts) as prev_ts from readings r)
       select p.row_id, case when prev_ts is null then null when p.ts - prev_ts <= 1 then 0e0 when prev_ts < e.a or p.ts - 1 > e.b then null
       else (select coalesce(sum(precip), 0) from s where s.station = p.station and s.ts > p.prev_ts and s.ts <= p.ts - 1) end as precip_interval from p join e using (station)""", "precip_interval")
def _(t):
    d = _at_station(weather.previous_date(t.readings))
    return weather.interval_sum_between_readings(d, t.station_daily, station="station").select("row_id", "precip_interval")


@query("annual_weather", "select * from annual", "temp_mean precip_total rh_mean wind_mean solar_mean")
def _(t):
    return t.annual


@query("join_year_broadcast", """select r.row_id, r.yr::bigint as yr, a.temp_mean, a.precip_total, a.rh_mean, a.wind_mean,
       a.solar_mean from readings r left join annual a using (yr)""", "temp_mean precip_total rh_mean wind_mean solar_mean")
def _(t):
    return weather.join_year(t.readings.select("row_id", "yr"), t.annual).select(
        "row_id", "yr", "temp_mean", "precip_total", "rh_mean", "wind_mean", "solar_mean")


@query("join_prior_year", """select r.row_id, r.yr::bigint as yr, a.yr::bigint as climate_year, a.temp_mean, a.precip_total,
       case when a.yr is null then 0e0 else 1e0 end as climate_available, case when a.yr is null then 'missing' else
       'prior_year' end as climate_check from readings r left join annual a on a.yr = r.yr - 1""",
       "temp_mean precip_total climate_available")
def _(t):
    return weather.join_prior_year(t.readings.select("row_id", "yr"), t.annual).select(
        "row_id", "yr", "climate_year", "temp_mean", "precip_total", "climate_available", "climate_check")


STAGE = ["prev_value", "gap_days", "roll3_mean", "hist_mean", "density", "delta", "precip_interval", "lat", "lon", "elev"] + ALLWIN


@query("stage1_feature_table", f"select row_id, entity_id, ts, cutoff, season, prior_count, {', '.join(STAGE)} from response",
       " ".join(STAGE))
def _(t):
    return t.response.select("row_id", "entity_id", "ts", "cutoff", "season", "prior_count", *STAGE)


@query("weather_variable_audit", " union all ".join(f"""select '{v}' as variable, count(*) as n,
       count(*) filter ({v} <= -990) as codes, count(*) filter ({v} is null) as nulls, min({v}) filter ({v} > -990) as v_min,
       avg({v}) filter ({v} > -990) as v_mean, median({v}) filter ({v} > -990) as v_median,
       max({v}) filter ({v} > -990) as v_max from daily_raw""" for v in weather.DAILY_VARIABLES), "v_min v_mean v_median v_max")
def _(t):
    return weather.weather_variable_audit(t.daily_raw)


@query("weather_coverage", """select count(*) as dates, count(*) filter (ts in (select ts from daily)) as covered,
       100e0 * count(*) filter (ts in (select ts from daily)) / count(*) as covered_pct
       from (select distinct ts from readings)""", "covered_pct")
def _(t):
    return weather.weather_coverage(t.readings, t.daily)


@query("all_null_years", """select r.yr::bigint as yr, case when count(a.temp_mean) = 0 then 1::bigint else 0::bigint end as temp_mean_all_null,
       case when count(a.precip_total) = 0 then 1::bigint else 0::bigint end as precip_total_all_null
       from readings r left join annual a on a.yr = r.yr - 1 group by r.yr""")
def _(t):
    d = weather.join_prior_year(t.readings, t.annual)
    return weather.all_null_years(d, ["temp_mean", "precip_total"])


@query("sentinel_to_null", "select ts, solar from daily", "solar")
def _(t):
    return weather.sentinel_to_null(t.daily_raw).select("ts", "solar")


@query("sentinel_counts", """select count(*) filter (precip <= -990) as precip_codes, count(*) filter (temp <= -990) as temp_codes,
       count(*) filter (rh <= -990) as rh_codes, count(*) filter (wind <= -990) as wind_codes,
       count(*) filter (solar <= -990) as solar_codes from daily_raw""")
def _(t):
    return weather.sentinel_counts(t.daily_raw)
