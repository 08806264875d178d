"""Role mapping: how the given tables play the parts of a monitoring data set.

orders = irregular readings, customer x nation = sites, lineitem by ship date = daily weather, orders x 3 = a
prediction log of three models, embeddings exploded = per-feature attributions. Values are kept on dyadic grids, so
sums agree bit for bit in any order of summation. `ORACLE` holds the same roles as DuckDB common table expressions."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import history, weather
from gaugeline.session import compiled

#: A target with signal, in SQL that both engines read.
SIGNAL = "coalesce(prev_value, 150e0) / 2 + 25 * least(coalesce(density, 0e0), 2e0) + case when elev > 2350 then 40e0 else 0e0 end + value / 8"
TRAIN_END, VALID_END = 1998, 1999      # temporal split of the mapped readings: <=1998, 1999, later


class Tables:
    """Lazily mapped tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = compiled(spark), folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as row_id", "o_custkey as entity_id", "cast(o_orderdate as date) as ts",
            "year(o_orderdate) as yr", "cast(floor(o_totalprice / 1e3) as double) as value",
            "case when o_orderstatus = 'P' then null else o_orderpriority end as season")

    @cached_property
    def sites(self) -> DataFrame:
        n = F.broadcast(self.raw("nation"))      # 25 rows by definition
        return self.raw("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
            "c_custkey as entity_id", "n_name as county", "40.35d + (c_custkey % 97) * 3.4e-3 as lat",
            "-99.64d + (c_custkey % 89) * 5.2e-3 as lon", "2200d + floor(c_acctbal / 30d) as elev")

    @cached_property
    def daily_raw(self) -> DataFrame:
        """Daily series with the missing code still in place."""
        return self.raw("lineitem").groupBy(F.expr("cast(l_shipdate as date)").alias("ts")).agg(
            F.expr("greatest(cast(sum(l_quantity) as bigint) % 10 - 5, 0) * 1d").alias("precip"),
            F.expr("floor(sum(floor(l_extendedprice)) / count(*) / 800d) / 4d").alias("temp"),
            F.expr("floor(sum(floor(l_discount * 100 + 0.5d)) / count(*) * 32d) / 2d").alias("rh"),
            F.expr("floor(sum(floor(l_tax * 100 + 0.5d)) / count(*) * 4d) / 4d").alias("wind"),
            F.expr("case when count(*) % 23 = 0 then -999d else floor(sum(l_quantity) / count(*) * 2d) / 4d end").alias("solar"))

    @cached_property
    def station_daily(self) -> DataFrame:
        """Daily series of seven stations: the line numbers."""
        return self.raw("lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("station"), F.expr("cast(l_shipdate as date)").alias("ts")).agg(
            F.expr("greatest(cast(sum(l_quantity) as bigint) % 10 - 5, 0) * 1d").alias("precip"),
            F.expr("floor(sum(floor(l_extendedprice)) / count(*) / 800d) / 4d").alias("temp"),
            F.expr("floor(sum(floor(l_discount * 100 + 0.5d)) / count(*) * 32d) / 2d").alias("rh"),
            F.expr("floor(sum(floor(l_tax * 100 + 0.5d)) / count(*) * 4d) / 4d").alias("wind"),
            F.expr("floor(sum(l_quantity) / count(*) * 2d) / 4d").alias("solar"))

    @cached_property
    def daily(self) -> DataFrame:
        return weather.sentinel_to_null(self.daily_raw)

    @cached_property
    def annual(self) -> DataFrame:
        return weather.annual_weather(self.daily)

    @cached_property
    def history(self) -> DataFrame:
        return history.history_features(self.readings)

    @cached_property
    def model_rows(self) -> DataFrame:
        """History, prior-year climate and site columns of every reading."""
        d = weather.join_prior_year(self.history, self.annual)
        return d.join(self.sites.drop("county"), "entity_id", "left")

    @cached_property
    def signal_rows(self) -> DataFrame:
        """Model rows with a target that follows their features: half the last level, steps by density and elevation, and the
        reading itself as noise."""
        return self.model_rows.withColumn("level", F.expr(SIGNAL))

    @cached_property
    def windows(self) -> DataFrame:
        return weather.dry_spell_streak(weather.rolling_day_windows(self.daily))

    @cached_property
    def response(self) -> DataFrame:
        """Readings with history, change target, prior-day windows, interval precipitation and site columns."""
        d = history.delta_target(self.history)
        d = weather.join_prior_day_windows(d, self.windows)
        d = d.withColumn("prev_ts", F.expr("date_sub(ts, cast(gap_days as int))"))
        d = weather.interval_sum_between_readings(d, self.daily)
        return d.join(self.sites.drop("county"), "entity_id", "left")

    @cached_property
    def predictions(self) -> DataFrame:
        """(row_id, model) unique; three deterministic models."""
        return self.predicted(self.readings)

    def predicted(self, readings: DataFrame, *keep: str) -> DataFrame:
        """Predictions for the given readings, whose `keep` columns go along. A join with this log is a merge join: Spark takes the size
        of exploded rows for that of the rows before, and would broadcast them."""
        models = F.explode(F.expr("array(named_struct('model','m1','k',1), named_struct('model','m2','k',2), "
                                  "named_struct('model','m3','k',5))")).alias("m")
        return readings.select("row_id", "entity_id", "ts", "yr", F.col("value").alias("y_true"), *keep, models).selectExpr(
            "row_id", "entity_id", "ts", "yr", "m.model as model", "y_true",
            "cast(floor(y_true * (1d + (((row_id * 7 + m.k * 3) % 21) - 10) / 64d) + 0.5d) as double) as y_pred", *keep).hint("merge")

    @cached_property
    def prediction_log(self) -> DataFrame:
        """Predictions with temporal split and cohort columns from the history table."""
        h = self.history.select("row_id", "prior_count", "gap_days")
        split = F.when(F.col("yr") <= TRAIN_END, "train").when(F.col("yr") <= VALID_END, "validation").otherwise("test")
        return self.predictions.join(h, "row_id").withColumn("split", split).withColumn(
            "cohort", F.when(F.col("prior_count") > 0, "warm").otherwise("cold"))

    @cached_property
    def seeded_log(self) -> DataFrame:
        """A run log over five seeds and three configurations, derived from the predictions."""
        return self.seeded(self.readings)

    def seeded(self, readings: DataFrame, *keep: str) -> DataFrame:
        """The run log of the given readings, whose `keep` columns go along: joined once a reading, not once a run."""
        grid = F.explode(F.expr("sequence(1, 5)")).alias("seed")
        cfg = F.explode(F.expr("array(named_struct('config','base','c',0), named_struct('config','meta','c',1), "
                               "named_struct('config','gated','c',2))")).alias("g")
        p = self.predicted(readings, *keep).where("model = 'm1'").select("row_id", "entity_id", "ts", "yr", "y_true", *keep, grid)
        p = p.select("*", cfg)
        return p.selectExpr(
            "seed", "g.config as config", "row_id", "entity_id", "ts", "yr", "y_true",
            "cast(floor(y_true * (1d + (((row_id * 7 + seed * 3 + g.c * 5) % (21 - g.c * 2)) - (10 - g.c)) / 64d) + 0.5d) as double) as y_pred", *keep)

    @cached_property
    def attributions(self) -> DataFrame:
        """Long table: row, feature position, feature value and its contribution."""
        e = self.raw("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("feature", "x"))
        return e.selectExpr(
            "vec_id", "label", "feature", "feature % 5 as block", "floor(cast(x as double) * 4096d) / 4096d as shap",
            "cast((vec_id * 31 + feature * 17) % 101 as double) as feature_value")

    @cached_property
    def raster(self) -> DataFrame:
        """Yearly grid cells in long form; value and extent follow from the readings' years and sites' region."""
        yrs = self.readings.select("yr").distinct()
        return yrs.selectExpr("yr", "explode(sequence(0, 29)) as r").selectExpr("yr", "r", "explode(sequence(0, 29)) as c").selectExpr(
            "yr", "r", "c", "case when (r * 7 + c * 3 + yr) % 53 = 0 then null else "
            "cast(((r * 13 + c * 29 + yr * 3) % 400) as double) + (r + c) / 4d end as cell")


ORACLE = {
    "readings": """select o_orderkey as row_id, o_custkey as entity_id, cast(o_orderdate as date) as ts,
        cast(year(o_orderdate) as integer) as yr, cast(floor(o_totalprice / 1e3) as double) as value,
        case when o_orderstatus = 'P' then null else o_orderpriority end as season from orders""",
    "sites": """select c_custkey as entity_id, n_name as county, 40.35e0 + (c_custkey % 97) * 3.4e-3::double as lat,
        -99.64e0 + (c_custkey % 89) * 5.2e-3::double as lon, 2200e0 + floor(c_acctbal / 30e0) as elev
        from customer join nation on c_nationkey = n_nationkey""",
    "daily_raw": """select cast(l_shipdate as date) as ts,
        greatest(cast(sum(l_quantity) as bigint) % 10 - 5, 0) * 1e0 as precip,
        floor(sum(floor(l_extendedprice)) / count(*) / 800e0) / 4e0 as temp,
        floor(sum(floor(l_discount * 100 + 0.5e0)) / count(*) * 32e0) / 2e0 as rh,
        floor(sum(floor(l_tax * 100 + 0.5e0)) / count(*) * 4e0) / 4e0 as wind,
        case when count(*) % 23 = 0 then -999e0 else floor(sum(l_quantity) / count(*) * 2e0) / 4e0 end as solar
        from lineitem group by cast(l_shipdate as date)""",
    "daily": "select ts, precip, temp, rh, wind, case when solar > -990 then solar end as solar from daily_raw",
    "annual": """select cast(year(ts) as integer) as yr, avg(temp) as temp_mean, sum(precip) as precip_total,
        avg(rh) as rh_mean, avg(wind) as wind_mean, avg(solar) as solar_mean from daily group by 1""",
    "days": "select entity_id, ts, avg(value) as m, count(*) as n from readings group by 1, 2",
    "day_lists": """select a.entity_id, a.ts, list(b.ts order by b.ts) filter (b.ts is not null) as pt,
        list(b.m order by b.ts) filter (b.ts is not null) as pm, coalesce(sum(b.n), 0) as pn,
        coalesce(sum(b.n) filter (b.ts >= a.ts - interval 3 year), 0) as pn3
        from days a left join days b on a.entity_id = b.entity_id and b.ts < a.ts group by 1, 2""",
    "day_hist": """select entity_id, ts, pm[-1] as prev_value, pm[-2] as prev2_value, pt[-1] as prev_ts,
        cast(ts - pt[-1] as double) as gap_days, cast(ts - pt[-1] as double) / 365.25e0 as gap_years,
        list_avg(pm[-3:]) as roll3_mean, case when len(pm) >= 2 then list_stddev_samp(pm[-3:]) end as roll3_std,
        pm[-1] - pm[-2] as prev_change, (pm[-1] - pm[-2]) / (cast(pt[-1] - pt[-2] as double) / 365.25e0) as recent_trend,
        list_avg(pm) as hist_mean, case when len(pm) >= 2 then list_stddev_samp(pm) end as hist_std,
        list_min(pm) as hist_min, list_max(pm) as hist_max, cast(pn as bigint) as prior_count, pn3 / 3e0 as density,
        case when ts - pt[-1] > 730.5 then 1::bigint else 0::bigint end as long_gap,
        case when ts - pt[-1] > 1095.75 then 1::bigint else 0::bigint end as very_long_gap from day_lists""",
    "hist": "select r.*, h.* exclude (entity_id, ts) from readings r join day_hist h using (entity_id, ts)",
    "model_rows": """select h.*, a.yr as climate_year, a.temp_mean, a.precip_total, a.rh_mean, a.wind_mean, a.solar_mean,
        case when a.yr is null then 0e0 else 1e0 end as climate_available,
        case when a.yr is null then 'missing' when a.yr < h.yr then 'prior_year' else 'violation' end as climate_check,
        s.lat, s.lon, s.elev from hist h left join annual a on a.yr = h.yr - 1 left join sites s using (entity_id)""",
    "signal_rows": f"select *, {SIGNAL} as level from model_rows",
    "windows": """select a.ts, """ + ", ".join(
        f"sum(b.precip) filter (b.ts > a.ts - {n}) as precip_{n}d" for n in (7, 14, 30, 60, 90, 180)) + """,
        sum(case when b.precip > 1 then 1e0 else 0e0 end) filter (b.ts > a.ts - 30) as rain_days_30d,
        max(b.precip) filter (b.ts > a.ts - 30) as max_precip_30d, avg(b.temp) filter (b.ts > a.ts - 30) as temp_mean_30d,
        max(b.temp) filter (b.ts > a.ts - 30) as temp_max_30d, sum(b.solar) filter (b.ts > a.ts - 30) as radiation_30d,
        avg(b.rh) filter (b.ts > a.ts - 30) as rh_mean_30d, avg(b.wind) filter (b.ts > a.ts - 30) as wind_mean_30d
        from daily a join daily b on b.ts <= a.ts and b.ts > a.ts - 180 group by a.ts""",
    "wet": "select ts, max(case when not coalesce(precip < 1, false) then ts end) over (order by ts rows unbounded preceding) as lw, row_number() over (order by ts) as n from daily",
    "dry": """select w.ts, cast(w.n - coalesce(v.n, 0) as double) as dry_spell_days from wet w left join wet v on v.ts = w.lw""",
    "response": """select h.*, h.prev_value - h.value as delta, h.ts - 1 as cutoff, w.* exclude (ts), d.dry_spell_days,
        case when h.ts - h.prev_ts = 1 then 0e0
          when h.prev_ts >= (select min(ts) from daily) and h.ts - 1 <= (select max(ts) from daily)
          then coalesce((select sum(x.precip) from daily x where x.ts > h.prev_ts and x.ts < h.ts), 0e0) end as precip_interval,
        s.lat, s.lon, s.elev
        from hist h left join windows w on w.ts = h.ts - 1 left join dry d on d.ts = h.ts - 1
        left join sites s using (entity_id)""",
    "predictions": """select row_id, entity_id, ts, yr, m.model, value as y_true,
        floor(value * (1e0 + (((row_id * 7 + m.k * 3) % 21) - 10) / 64e0) + 0.5e0) as y_pred
        from readings cross join (select 'm1' as model, 1 as k union all select 'm2', 2 union all select 'm3', 5) m""",
    "plog": """select p.*, h.prior_count, h.gap_days,
        case when p.yr <= 1998 then 'train' when p.yr <= 1999 then 'validation' else 'test' end as split,
        case when h.prior_count > 0 then 'warm' else 'cold' end as cohort
        from predictions p join (select row_id, prior_count, gap_days from hist) h using (row_id)""",
    "slog": """select s.seed, g.config, row_id, entity_id, ts, yr, value as y_true,
        floor(value * (1e0 + (((row_id * 7 + s.seed * 3 + g.c * 5) % (21 - g.c * 2)) - (10 - g.c)) / 64e0) + 0.5e0) as y_pred
        from readings cross join (select unnest([1,2,3,4,5]) as seed) s
        cross join (select 'base' as config, 0 as c union all select 'meta', 1 union all select 'gated', 2) g""",
    "attributions": """select vec_id, label, feature, feature % 5 as block,
        floor(cast(x as double) * 4096e0) / 4096e0 as shap, cast((vec_id * 31 + feature * 17) % 101 as double) as feature_value
        from (select vec_id, label, unnest(range(len(embedding)))::integer as feature, unnest(embedding) as x from embeddings)""",
    "raster": """select yr, r, c, case when (r * 7 + c * 3 + yr) % 53 = 0 then null else
        cast(((r * 13 + c * 29 + yr * 3) % 400) as double) + (r + c) / 4e0 end as cell
        from (select distinct yr from readings), (select unnest(range(30))::integer as r), (select unnest(range(30))::integer as c)""",
}
def with_roles(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a DuckDB statement with the role tables it mentions, directly or through other role tables."""
    texts = ORACLE | (extra or {})
    order: list[str] = []

    def need(text: str, own: str = ""):
        for name in texts:
            if name != own and name not in order and re.search(rf"(from|join|,)\s+\(?{name}\b(?!\s*\()", text):
                need(texts[name], name)
                order.append(name)

    need(body)
    if not order:
        return body
    head = "with " + ",\n".join(f"{n} as materialized ({texts[n]})" for n in order)
    own = body.lstrip()
    return head + (",\n" + own[5:] if own.lower().startswith("with ") else "\n" + body)
