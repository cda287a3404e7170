"""Point-in-time resolution: which revision of each fact was known at an issue time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..guards import Refused, refuse_if_any

KEY = ("source_id", "source_record_id")


def available(known_at: Column, issue: Column | datetime) -> Column:
    return known_at <= (issue if isinstance(issue, Column) else F.lit(issue))


def as_of(obs: DataFrame, issue: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """The revision with the highest sequence known at ``issue``, for each key. One partial aggregation, no sort."""
    known = obs.where(F.col("known_at") <= issue)
    top = known.groupBy(*key).agg(F.max_by(F.struct(*known.columns), "revision_sequence").alias("row"))
    return top.select("row.*")


def conflicts(obs: DataFrame, issue: Column | None = None, *payload: str) -> DataFrame:
    """Revisions of one sequence that differ, among those eligible at ``issue``."""
    known = obs if issue is None else obs.where(F.col("known_at") <= issue)
    return known.groupBy(*KEY, "revision_sequence").agg(F.count_distinct(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).alias("variants")).where("variants > 1")


def resolve(obs: DataFrame, issue: Column, *payload: str) -> DataFrame:
    """``as_of`` that refuses conflicting eligible revisions."""
    if not conflicts(obs, issue, *payload).isEmpty():
        raise Refused("conflicting revisions")
    return as_of(obs, issue)


def validity(obs: DataFrame) -> DataFrame:
    """When each revision was the one in force: known_at up to next_known_at (null: still)."""
    by_key = Window.partitionBy(*KEY)
    earlier = F.max("revision_sequence").over(by_key.orderBy("known_at", "revision_sequence").rowsBetween(Window.unboundedPreceding, -1))
    rising = obs.withColumn("best", earlier).where("best is null or revision_sequence > best")
    one = rising.groupBy(*KEY, "known_at").agg(F.max("revision_sequence").alias("revision_sequence"))
    return one.withColumn("next_known_at", F.lead("known_at").over(by_key.orderBy("known_at")))


def as_of_many(obs: DataFrame, issues: DataFrame) -> DataFrame:
    """issue, key and sequence in force, for many issue times (column ``issue``).

    A revision in force is sent to the days of its validity that have an issue, and meets the issues of each day there.
    The driver collects the days, not the issues.
    """
    spans = validity(obs)
    days = [r["day"] for r in issues.select(F.to_date("issue").alias("day")).where("day is not null").distinct().orderBy("day").collect()]
    asked = F.array(*(F.lit(d) for d in days)) if days else F.array().cast("array<date>")
    own = F.filter(asked, lambda d: (d >= F.to_date("known_at")) & (F.col("next_known_at").isNull() | (d <= F.to_date("next_known_at"))))
    met = issues.select("issue", F.to_date("issue").alias("day")).distinct()
    inside = (F.col("issue") >= F.col("known_at")) & (F.col("next_known_at").isNull() | (F.col("issue") < F.col("next_known_at")))
    return spans.withColumn("day", F.explode(own)).join(met, "day").where(inside).select("issue", *KEY, "revision_sequence")


def resolve_sources(sources: list[DataFrame], issue: Column, *payload: str) -> DataFrame:
    """``resolve`` of several sources at once; a key that two of them hold is refused."""
    if not sources:
        raise Refused("no sources")
    rows = sources[0].withColumn("_s", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_s", F.lit(k)))
    if not rows.groupBy(*KEY).agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a <> b").isEmpty():
        raise Refused("a key stands in several sources")
    return resolve(rows.drop("_s"), issue, *payload)


def in_horizon(rows: DataFrame, issue: Column, least_hours: int, most_hours: int, time: str = "event_time") -> DataFrame:
    """Rows whose time lies within the horizon; applied after resolution."""
    lead = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(issue.cast("timestamp"))) / 3_600_000_000
    return rows.where(lead.between(least_hours, most_hours))


def latest_per_source(obs: DataFrame, issue: Column) -> DataFrame:
    """Each source's latest event known at ``issue`` and not after it."""
    known = obs.where((F.col("known_at") <= issue) & (F.col("event_time") <= issue))
    top = known.groupBy("source_id").agg(F.max_by(F.struct("source_record_id", "event_time", "revision_sequence", "value", "event_id"), F.struct("event_time", "revision_sequence", "event_id")).alias("row"))
    return top.select("source_id", "row.*")


def reconstructed_known_at(rows: DataFrame, lag: Column, policy: str = "publication_plus_lag") -> DataFrame:
    """Adds known_at and known_at_reconstructed from publication_time, first_received_at and normalized_at.

    ``require`` refuses rows without an explicit known_at.
    """
    if policy == "require":
        return refuse_if_any(rows, without_known_at=F.col("known_at").isNull()).withColumn("known_at_reconstructed", F.lit(False))
    received = F.coalesce("first_received_at", "publication_time")
    own = F.greatest(F.col("publication_time") + lag, received, F.coalesce(F.col("normalized_at"), received))
    return rows.select("*", F.col("known_at").isNull().alias("known_at_reconstructed"), own.alias("_own")).withColumn("known_at", F.coalesce("known_at", "_own")).drop("_own")


def dataset_as_of(obs: DataFrame, sources: DataFrame, issue: Column) -> DataFrame:
    """``as_of`` of a dataset's member sources: a foreign source or a unit that its source does not name is refused."""
    if not obs.join(sources, "source_id", "left_anti").isEmpty():
        raise Refused("foreign source")
    rows = obs.join(sources.select("source_id", "units"), "source_id")
    return as_of(refuse_if_any(rows, unit=~F.array_contains("units", F.col("unit"))).drop("units"), issue)
