"""Queries: hourly series, lags, windows and fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..sources import readers
from .resolution import I, r6
from .views import HOURS, OBS, TARGETS, at, hours, observations, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


@query("""select o_custkey % 7 as key, date_trunc('hour', t) as hour, round(avg(o_totalprice), 4) as value from (
  select o_custkey, case when o_orderkey % 11 <> 0 then o_totalprice end as o_totalprice, o_orderdate + to_minutes(cast(15 * (o_orderkey % 5) as int)) as t from orders)
group by 1, 2 having count(o_totalprice) = 4 and count(distinct case when o_totalprice is not null and epoch_us(t) % 900000000 = 0 then t end) = 4""")
def hourly_complete_mean(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("key"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (15 * (F.col("o_orderkey") % 5)).cast("int"))).alias("t"))
    return series.complete_hourly_mean(rows, "t", ["key"], "value").withColumn("value", F.round("value", 4))


@query("select event_type as source_id, date_trunc('hour', ts) as hour, round(avg(value), 6) as value from events group by 1, 2")
def hourly_mean(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "source_id")
    return series.hourly_mean(e, "ts", ["source_id"], ["value"]).withColumn("value", r6("value"))


@query("select date_trunc('hour', ts) as hour, " + ", ".join(f"round(avg(case when event_type = '{t}' then value end), 6) as {t}" for t in [*TARGETS, "error"]) + " from events group by 1")
def pivot_hourly(spark, d):
    names = [*TARGETS, "error"]
    return series.pivot_hourly(table(spark, d, "events"), "ts", "event_type", names, "value").select("hour", *(r6(n).alias(n) for n in names))


@query(f"with {HOURS} select a.source_id, a.hour, round(a.value, 6) as value, round(b.value, 6) as lag_168 from hours a left join hours b on b.source_id = a.source_id and b.hour = a.hour - interval 168 hour and b.hour <= {I}")
def exact_lag_join(spark, d):
    return series.exact_lag(hours(spark, d), ["source_id"], 168, at()).select("source_id", "hour", r6("value").alias("value"), r6("lag_168").alias("lag_168"))


LAGS = [1, 24, 48, 168]


@query(f"with {HOURS} select a.source_id, a.hour, round(a.value, 6) as value, " + ", ".join(f"round(l{k}.value, 6) as lag_{k}" for k in LAGS) + " from hours a " + " ".join(f"left join hours l{k} on l{k}.source_id = a.source_id and l{k}.hour = a.hour - interval {k} hour" for k in LAGS))
def lag_feature_matrix(spark, d):
    wide = series.lag_features(hours(spark, d), ["source_id"], LAGS)
    return wide.select("source_id", "hour", r6("value").alias("value"), *(r6(f"lag_{k}").alias(f"lag_{k}") for k in LAGS))


@query(f"""with {HOURS}, w as (select *, count(value) over f as c, avg(value) over f as m, stddev_pop(value) over f as s from hours window f as (partition by source_id order by hour range between interval 3 hour preceding and interval 1 hour preceding))
select source_id, hour, round(case when c = 3 then m end, 6) as mean_3, round(case when c = 3 then s end, 6) as std_3 from w""")
def rolling_from_lags(spark, d):
    return series.rolling_from_lags(hours(spark, d), ["source_id"], 3).select("source_id", "hour", r6("mean_3").alias("mean_3"), r6("std_3").alias("std_3"))


def _elapsed(name: str, sql: str):
    @query(f"with {OBS}, w as (select *, count(value) over f as c, count(*) over f as n, {sql}(value) over f as x from obs window f as (partition by source_id order by event_time range between interval '21599999999 microseconds' preceding and current row)) select event_id, round(case when c = n then x end, 6) as {name} from w")
    def run(spark, d):
        return series.elapsed_window(observations(spark, d), ["source_id"], "event_time", 6).select("event_id", r6(name).alias(name))

    QUERIES[f"elapsed_rolling_{name[2:]}"] = QUERIES.pop("run")


for _n, _s in (("w_mean", "avg"), ("w_std", "stddev_pop"), ("w_min", "min"), ("w_max", "max")):
    _elapsed(_n, _s)


@query(f"with {HOURS} select a.source_id, a.hour, round((a.value - b.value) / 7200, 9) as rate from hours a left join hours b on b.source_id = a.source_id and b.hour = a.hour - interval 2 hour")
def rate_of_change(spark, d):
    return series.rate_of_change(hours(spark, d), ["source_id"], 2).select("source_id", "hour", F.round("rate", 9).alias("rate"))


@query(f"with {OBS}, k as (select * from obs where known_at <= {I} and event_time <= {I}) select source_id, round((epoch_us({I}) - epoch_us(max(event_time))) / 1000000, 6) as freshness, case when arg_max_null(value, (event_time, event_id)) is null then 1.0::double else 0.0::double end as missing_flag from k group by 1")
def freshness_missing_flag(spark, d):
    return series.freshness(observations(spark, d), at()).withColumn("freshness", r6("freshness"))


@query("select event_id, (isodow(ts) - 1)::int as weekday, hour(ts)::int as hour_of_day, month(ts)::int as month, isodow(ts) >= 6 as weekend, round(sin(2 * pi() * hour(ts) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) as hour_cos from events")
def calendar_cyclic(spark, d):
    rows = series.calendar(table(spark, d, "events"), "ts")
    return rows.select("event_id", "weekday", "hour_of_day", "month", "weekend", (r6("hour_sin") + 0.0).alias("hour_sin"), (r6("hour_cos") + 0.0).alias("hour_cos"))


@query(f"with {OBS}, i as (select s.source_id, t.i as issue from (select distinct source_id from obs) s, generate_series(timestamp '2024-01-05', timestamp '2024-01-25', interval 6 hour) t(i)) select i.source_id, i.issue, round(coalesce(sum(o.value), 0), 4) as window_sum from i left join obs o on o.source_id = i.source_id and o.known_at between i.issue - interval 24 hour and i.issue group by 1, 2")
def window_sum_closed(spark, d):
    obs = observations(spark, d)
    return series.window_sum(obs, _issues(spark, obs), ["source_id"], 24).withColumn("window_sum", F.round("window_sum", 4))


def _issues(spark, obs):
    grid = spark.range(81).select((at("2024-01-05 00:00:00") + F.make_dt_interval(F.lit(0), (F.col("id") * 6).cast("int"))).alias("issue"))
    return obs.select("source_id").distinct().crossJoin(F.broadcast(grid))


@query(f"with {OBS}, o as (select source_id, known_at, max(event_id) as event_id, from obs group by 1, 2), i as (select s.source_id, t.i as issue from (select distinct source_id from obs) s, generate_series(timestamp '2024-01-05', timestamp '2024-01-25', interval 6 hour) t(i)) select i.source_id, i.issue, o.known_at as event_at, o.event_id::double as value from i asof left join o on o.source_id = i.source_id and o.known_at <= i.issue")
def event_asof_latest(spark, d):
    obs = observations(spark, d)
    return series.latest_before(obs.withColumn("value", F.col("event_id").cast("double")), _issues(spark, obs), ["source_id"])


@query(f"""with {HOURS}, k as (select * from hours where hour <= {I}), t as (select s.source_id, g.h as hour from (select distinct source_id from hours) s, generate_series({I} + interval 1 hour, {I} + interval 336 hour, interval 1 hour) g(h)),
l as (select source_id, arg_max(value, hour) as latest from k group by 1),
j as (select t.source_id, t.hour, a.value as a, b.value as b, c.value as c, e.value as e, latest from t left join k a on a.source_id = t.source_id and a.hour = t.hour - interval 168 hour left join k b on b.source_id = t.source_id and b.hour = t.hour - interval 167 hour
  left join k c on c.source_id = t.source_id and c.hour = t.hour - interval 169 hour left join k e on e.source_id = t.source_id and e.hour = t.hour - interval 336 hour left join l on l.source_id = t.source_id)
select source_id, hour, round(coalesce(a, b, c, e, latest), 6) as value, case when a is not null then 'exact_168h' when b is not null then 'nearby_167h' when c is not null then 'nearby_169h' when e is not null then 'previous_week_336h' when latest is not null then 'latest_causal' end as label from j""")
def seasonal_fallback(spark, d):
    h = hours(spark, d)
    return series.seasonal_fallback(_ahead(spark, h, 336), h, ["source_id"], at()).withColumn("value", r6("value"))


def _ahead(spark, h, n):
    grid = spark.range(1, n + 1).select((at() + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"))
    return h.select("source_id").distinct().crossJoin(F.broadcast(grid))


@query(f"""with {HOURS}, t as (select s.source_id, g.h as hour from (select distinct source_id from hours) s, generate_series({I} + interval 1 hour, {I} + interval 400 hour, interval 1 hour) g(h)),
j as (select t.source_id, t.hour, x.value from t left join hours x on x.source_id = t.source_id and x.hour in (t.hour - interval 504 hour, t.hour - interval 672 hour, t.hour - interval 840 hour))
select source_id, hour, round(quantile_cont(value, 0.5), 6) as value from j group by 1, 2""")
def long_lead_median(spark, d):
    h = hours(spark, d)
    return series.long_lead_median(_ahead(spark, h, 400), h, ["source_id"]).withColumn("value", r6("value"))


@query(f"""with {HOURS}, g as (select s.source_id, t.h as hour from (select distinct source_id from hours) s, generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:00:00', interval 1 hour) t(h))
select source_id, count(*) as missing_hours, min(hour) as first_missing from g anti join hours using (source_id, hour) group by 1""")
def missing_hours(spark, d):
    h = hours(spark, d)
    grid = series.hour_grid(spark, at("2024-01-01 00:00:00"), at("2024-01-30 23:00:00"))
    all_ = h.select("source_id").distinct().crossJoin(F.broadcast(grid))
    return all_.join(h, ["source_id", "hour"], "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("missing_hours"), F.min("hour").alias("first_missing"))


@query(f"""with {OBS}, o as (select source_id, greatest(known_at, event_time) as at, event_time, value from obs), i as (select t.i as issue from generate_series(timestamp '2024-01-05', timestamp '2024-01-25', interval 12 hour) t(i)),
x as (select i.issue, o.source_id, arg_max_null(o.value, (o.at, o.value)) as value, max(o.at) as last from i join o on o.at <= i.issue group by 1, 2)
select issue, source_id, round(coalesce(value, 0), 6) as value, value is null as missing, epoch_us(issue) - epoch_us(last) > 3 * 3600000000 as stale from x""")
def issue_snapshot(spark, d):
    issues = spark.range(41).select((at("2024-01-05 00:00:00") + F.make_dt_interval(F.lit(0), (F.col("id") * 12).cast("int"))).alias("issue"))
    names = ["click", "error", "purchase", "signup", "view"]
    wide = series.snapshot(observations(spark, d), issues, names)
    long = wide.select("issue", F.explode(F.array(*(F.struct(F.lit(n).alias("source_id"), r6(f"{n}_value").alias("value"), (F.col(f"{n}_missing") == 1).alias("missing"), (F.col(f"{n}_stale") == 1).alias("stale")) for n in names))).alias("x"))
    return long.select("issue", "x.*")


@query("""with fit as (select avg(value) as m, stddev_pop(value) as s from events where ts < timestamp '2024-01-15') select event_id, round((value - m) / coalesce(nullif(s, 0), 1), 6) as value from events, fit""")
def fold_standard_scale(spark, d):
    return series.standard_scale(table(spark, d, "events"), F.col("ts") < at(), ["value"]).select("event_id", r6("value").alias("value"))


@query("select count(*) as n, round(sum(value), 4) as total, min(ts) as first from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'")
def range_scan(spark, d):
    table(spark, d, "events").createOrReplaceTempView("chronolake_range_scan")
    rows = readers.table_range(spark, "chronolake_range_scan", "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"))
