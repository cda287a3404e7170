"""Queries: resolution as of an issue time, and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import number
from ..operators import pit, quality, scoring
from ..operators.graph import ancestors
from .views import ISSUE, OBS, at, observations, table

QUERIES: dict = {}
I = f"timestamp '{ISSUE}'"  # noqa: E741


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def r6(c):
    return F.round(c, 6)


TOP = f"""{OBS},
top as (select * from obs where known_at <= {I} qualify row_number() over (partition by source_id, source_record_id order by revision_sequence desc) = 1)"""


@query(f"with {TOP} select source_id, source_record_id, revision_sequence, event_time, known_at, value, unit from top")
def asof_resolve(spark, d):
    return pit.as_of(observations(spark, d), at()).select("source_id", "source_record_id", "revision_sequence", "event_time", "known_at", "value", "unit")


ISSUE_DAYS = "select i as issue from generate_series(timestamp '2024-01-03', timestamp '2024-01-28', interval 1 day) t(i)"


@query(f"with {OBS}, iss as ({ISSUE_DAYS}) select issue, source_id, source_record_id, max(revision_sequence) as revision_sequence from obs join iss on known_at <= issue group by 1, 2, 3")
def asof_many_issues(spark, d):
    days = spark.range(26).select((at("2024-01-03 00:00:00") + F.make_dt_interval(F.col("id").cast("int"))).alias("issue"))
    return pit.as_of_many(observations(spark, d), days)


@query(f"with {TOP} select source_id, source_record_id, revision_sequence, event_time from top where event_time between {I} - interval 48 hour and {I}")
def asof_horizon_scope(spark, d):
    now = pit.as_of(observations(spark, d), at())
    return pit.in_horizon(now, at(), -48, 0).select("source_id", "source_record_id", "revision_sequence", "event_time")


@query(f"with {OBS} select source_id, source_record_id, revision_sequence // 3 as revision_sequence, count(distinct unit || '/' || coalesce(cast(value as varchar), 'null')) as variants from obs where known_at <= {I} group by 1, 2, 3 having count(distinct unit || '/' || coalesce(cast(value as varchar), 'null')) > 1")
def asof_conflicts(spark, d):
    coarse = observations(spark, d).withColumn("revision_sequence", F.floor(F.col("revision_sequence") / 3))
    return pit.conflicts(coarse, at(), "unit", "value")


@query(f"with {OBS} select source_id, arg_max(source_record_id, (event_time, revision_sequence, event_id)) as source_record_id, max(event_time) as event_time, arg_max(revision_sequence, (event_time, revision_sequence, event_id)) as revision_sequence from obs where known_at <= {I} and event_time <= {I} group by 1")
def latest_per_source(spark, d):
    return pit.latest_per_source(observations(spark, d), at()).select("source_id", "source_record_id", "event_time", "revision_sequence")


@query(f"with {OBS} select event_id, source_id, known_at from obs where known_at <= {I}")
def availability_filter(spark, d):
    return observations(spark, d).where(pit.available(F.col("known_at"), at())).select("event_id", "source_id", "known_at")


@query("""select event_id, coalesce(k, greatest(ts + interval 2 hour, r, coalesce(n, r))) as known_at, k is null as known_at_reconstructed from (
  select event_id, ts, case when event_id % 3 = 0 then ts + interval 1 hour end as k, case when event_id % 5 = 0 then ts else ts + interval 30 minute end as r, case when event_id % 2 = 0 then ts + interval 4 hour end as n from events)""")
def known_at_reconstruct(spark, d):
    plus = lambda minutes: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    rows = table(spark, d, "events").select(
        "event_id", F.col("ts").alias("publication_time"), F.when(F.col("event_id") % 3 == 0, plus(60)).alias("known_at"),
        F.when(F.col("event_id") % 5 != 0, plus(30)).alias("first_received_at"), F.when(F.col("event_id") % 2 == 0, plus(240)).alias("normalized_at"),
    )
    return pit.reconstructed_known_at(rows, F.make_dt_interval(F.lit(0), F.lit(2))).select("event_id", "known_at", "known_at_reconstructed")


@query("select event_id, case when event_type = 'error' then null else event_type end as kind, try_cast(json_extract_string(props, '$.k') as double) as k from events")
def column_mapping_nullif(spark, d):
    from ..sources.readers import mapped

    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("type"), F.get_json_object("props", "$.k").alias("k"))
    return mapped(rows, {"event_id": "event_id", "kind": "type", "k": "k"}).select("event_id", "kind", number(F.col("k")).alias("k"))


@query(f"""with {OBS}, many as (select *, count(*) over (partition by source_id, event_time, unit) as c from obs)
select event_id, concat_ws(',', case when value is null then 'MISSING' end, case when epoch_us({I}) - epoch_us(event_time) > 864000 * 1000000::bigint then 'STALE' end, case when revision_sequence > 0 then 'REVISED' end,
  case when c > 1 then 'DUPLICATE' end, case when not value between 1 and 60 then 'OUT_OF_RANGE' end, case when known_at > {I} then 'UNAVAILABLE_AT_ISSUE' end) as flags from many""")
def quality_flags(spark, d):
    return quality.flags(observations(spark, d), at(), 864000, 1, 60, ("source_id", "event_time", "unit")).select("event_id", "flags")


@query(f"with {OBS} select source_id, count(*) as rows, count(*) filter (value is null) as missing, round(count(*) filter (value is null) / count(*), 6) as fraction from obs group by 1")
def missingness(spark, d):
    return quality.missingness(observations(spark, d)).withColumn("fraction", r6("fraction"))


@query("select count(*) as duplicate_groups, coalesce(sum(c - 1), 0)::bigint as duplicate_rows from (select count(*) as c from events group by event_type, user_id, date_trunc('day', ts) having count(*) > 1)")
def duplicate_identities(spark, d):
    return quality.duplicates(table(spark, d, "events").withColumn("day", F.to_date("ts")), "event_type", "user_id", "day")


@query(f"with {OBS}, s as (select source_id, source_record_id, count(distinct revision_sequence) as k from obs group by 1, 2) select source_id, count(*) as series, count(*) filter (k > 1) as revised_series, sum(k - 1)::bigint as revision_rows from s group by 1")
def revision_frequency(spark, d):
    return quality.revisions(observations(spark, d))


@query(f"with {OBS} select source_id, string_agg(distinct unit, ',' order by unit) as units, count(distinct unit) = 1 as consistent from obs group by 1")
def unit_consistency(spark, d):
    return quality.units(observations(spark, d))


GAPS = f"{OBS}, t as (select distinct source_id, event_time from obs), g as (select source_id, event_time, lead(event_time) over (partition by source_id order by event_time) as next_time, epoch_us(lead(event_time) over (partition by source_id order by event_time)) - epoch_us(event_time) as gap from t), m as (select source_id, quantile_cont(gap, 0.5) as median from g where gap > 0 group by 1)"


@query(f"with {GAPS} select source_id, round(median / 1000000, 6) as median_seconds from m")
def cadence_median(spark, d):
    return quality.cadence(observations(spark, d)).withColumn("median_seconds", r6("median_seconds"))


@query(f"with {GAPS} select source_id, event_time, next_time, round(gap / 1000000, 6) as gap_seconds from g join m using (source_id) where gap > 1.5 * median")
def gap_report(spark, d):
    return quality.long_gaps(observations(spark, d), 1.5).withColumn("gap_seconds", r6("gap_seconds"))


@query(f"with {GAPS}, l as (select source_id, max(event_time) as last_event from obs where known_at <= {I} group by 1) select source_id, last_event, round((epoch_us({I}) - epoch_us(last_event)) / 1000000, 6) as age_seconds, (epoch_us({I}) - epoch_us(last_event)) > 2 * median as stale from m join l using (source_id)")
def stale_report(spark, d):
    return quality.stale_sources(observations(spark, d), at()).withColumn("age_seconds", r6("age_seconds"))


@query(f"with {OBS} select source_id, count(*) filter (known_at <= {I} and event_time + interval 2 day > {I}) as future_rows from obs group by 1")
def future_availability(spark, d):
    ahead = observations(spark, d).withColumn("event_time", F.col("event_time") + F.make_dt_interval(F.lit(2)))
    return quality.future_availability(ahead, at())


@query(f"with {OBS}, h as (select unnest([1, 6, 12, 24, 36, 48])::bigint as horizon) select source_id, horizon, coalesce(bool_or(known_at <= {I} and epoch_us(date_trunc('hour', event_time)) + 172800000000 = epoch_us({I}) + horizon * 3600000000), false) as available from obs cross join h group by 1, 2")
def horizon_availability(spark, d):
    ahead = F.date_trunc("hour", F.col("event_time")) + F.make_dt_interval(F.lit(2))
    return quality.horizon_matrix(observations(spark, d), at(), [1, 6, 12, 24, 36, 48], ahead)


@query(f"with {OBS} select source_id, count(*) as rows, count(distinct event_time) as event_times, count(*) filter (known_at <= {I}) as eligible, round(count(*) filter (known_at <= {I}) / count(*), 6) as eligible_fraction, min(event_time) as first_event, max(event_time) as last_event, string_agg(distinct unit, ',' order by unit) as units from obs group by 1")
def source_coverage(spark, d):
    return quality.coverage(observations(spark, d), at()).withColumn("eligible_fraction", r6("eligible_fraction"))


@query(f"with {OBS} select distinct cast(epoch_us(date_trunc('hour', event_time)) // 3600000000 - epoch_us({I}) // 3600000000 as bigint) as horizon from obs where event_time > {I} order by 1 limit 10")
def topk_horizons(spark, d):
    lead = (F.floor(quality.micros("event_time") / 3600000000) - F.floor(quality.micros(at()) / 3600000000)).alias("horizon")
    return observations(spark, d).where(F.col("event_time") > at()).select(lead).distinct().orderBy("horizon").limit(10)


@query(f"with {OBS} select source_id from (select source_id, source_record_id from obs except select source_id, source_record_id from obs where known_at <= timestamp '2024-01-03 00:00:00') group by 1")
def set_difference_sources(spark, d):
    obs = observations(spark, d).select("source_id", "source_record_id", "known_at")
    early = obs.where(F.col("known_at") <= at("2024-01-03 00:00:00")).drop("known_at")
    return scoring.unmatched_keys(obs, early, "source_id", "source_record_id").select("source_id").distinct()


@query("""with recursive edges as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'r' || r_regionkey, 'world' from region union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
up(node, ancestor) as (select child, parent from edges union select u.node, e.parent from up u join edges e on e.child = u.ancestor)
select node, ancestor from up""")
def dag_ancestors(spark, d):
    edges = (
        table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
        .unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent")))
        .unionByName(table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent")))
    )
    return ancestors(edges)
