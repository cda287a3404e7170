"""Base views over the driver's tables, the same in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import hour

ISSUE = "2024-01-15 00:00:00"
TARGETS = ["click", "purchase", "signup", "view"]

OBS = """obs as (
  select event_type as source_id, 'u' || user_id as source_record_id,
    row_number() over (partition by event_type, user_id order by ts, event_id) - 1 as revision_sequence,
    ts as event_time, ts + to_hours(cast((event_id % 7) * 6 as int)) as known_at,
    case when event_id % 29 = 0 then null else value end as value,
    case when event_id % 97 = 0 then 'kW' else 'MW' end as unit, event_id
  from events)"""

HOURS = "hours as (select event_type as source_id, date_trunc('hour', ts) as hour, avg(value) as value, count(*) as n from events group by 1, 2)"

SAMP = """tot as (select date_trunc('hour', ts) as h, avg(value) as v from events group by 1),
samp as (
  select 'r' || strftime(a.h, '%Y%m%d%H') as row_id, a.h as issue_time, a.h + interval 1 hour as target_time, a.h as feature_known_at,
    a.h + interval 2 hour as label_known_at, extract(hour from a.h) as hod, a.v as now_value, b.v as target
  from tot a join tot b on b.h = a.h + interval 1 hour)"""

#: Samples of each target at the hours where all four have one.
TSAMP = f"""{HOURS},
tsamp as (
  select a.source_id as target_name, 'r' || strftime(a.hour, '%Y%m%d%H') as row_id, a.hour as issue_time, a.hour + interval 1 hour as target_time, a.hour as feature_known_at,
    a.hour + interval 2 hour as label_known_at, extract(hour from a.hour) as hod, a.value as now_value, b.value as target
  from hours a join hours b on b.source_id = a.source_id and b.hour = a.hour + interval 1 hour where a.source_id in ({", ".join(repr(t) for t in TARGETS)})
  qualify count(*) over (partition by a.hour) = 4)"""

ARRAYS = """arrays as (
  select vec_id, list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 1000, 0) as int)) as samples, cast(embedding[1] as double) * 1000 as first from embeddings),
pairs as (select a.vec_id, a.samples, b.first as truth from arrays a join arrays b on b.vec_id = a.vec_id + 1)"""


def at(text: str = ISSUE) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_type").alias("source_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_record_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("revision_sequence"), F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), ((F.col("event_id") % 7) * 6).cast("int"))).alias("known_at"),
        F.when(F.col("event_id") % 29 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 97 == 0, "kW").otherwise("MW").alias("unit"), "event_id",
    )


def hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("source_id"), hour("ts").alias("hour")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    one = F.make_dt_interval(F.lit(0), F.lit(1))
    nxt = t.select((F.col("h") - one).alias("h"), F.col("v").alias("target"))
    return t.join(nxt, "h").select(
        F.concat(F.lit("r"), F.date_format("h", "yyyyMMddHH")).alias("row_id"), F.col("h").alias("issue_time"), (F.col("h") + one).alias("target_time"), F.col("h").alias("feature_known_at"),
        (F.col("h") + one + one).alias("label_known_at"), F.hour("h").alias("hod"), F.col("v").alias("now_value"), "target", F.array(F.hour("h").cast("double"), F.col("v")).alias("features"),
    )


def target_samples(spark: SparkSession, d: str) -> DataFrame:
    h = hours(spark, d).where(F.col("source_id").isin(*TARGETS)).select(F.col("source_id").alias("target_name"), "hour", "value")
    one = F.make_dt_interval(F.lit(0), F.lit(1))
    rows = h.join(h.select("target_name", (F.col("hour") - one).alias("hour"), F.col("value").alias("target")), ["target_name", "hour"])
    whole = rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(TARGETS)).select("hour")
    return rows.join(whole, "hour").select(
        "target_name", F.concat(F.lit("r"), F.date_format("hour", "yyyyMMddHH")).alias("row_id"), F.col("hour").alias("issue_time"), (F.col("hour") + one).alias("target_time"), F.col("hour").alias("feature_known_at"),
        (F.col("hour") + one + one).alias("label_known_at"), F.hour("hour").alias("hod"), F.col("value").alias("now_value"), "target", F.array(F.hour("hour").cast("double"), F.col("value")).alias("features"),
    )


def arrays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    own = e.select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("int")).alias("samples"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), (F.get("embedding", F.lit(0)).cast("double") * 1000).alias("truth"))
    return own.join(nxt, "vec_id")
