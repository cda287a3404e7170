"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pit, quality, series
from .plans import backtest, evaluation, resolution, timeseries, views

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source at one issue time: resolved series, missing values, coverage and freshness."""
    obs = views.observations(spark, sf_dir)
    now = pit.as_of(obs, views.at())
    resolved = now.groupBy("source_id").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(F.col("value").isNull()).alias("missing"), F.max("event_time").alias("last_event"))
    cover = quality.coverage(obs, views.at()).select("source_id", "rows", "eligible", "units")
    return resolved.join(cover, "source_id").join(series.freshness(obs, views.at()), "source_id").orderBy("source_id")


FLAGSHIP_SQL = f"""with {views.OBS}, i as (select timestamp '{views.ISSUE}' as t),
top as (select obs.* from obs, i where known_at <= t qualify row_number() over (partition by source_id, source_record_id order by revision_sequence desc) = 1),
r as (select source_id, count(*) as resolved, count(*) filter (value is null) as missing, max(event_time) as last_event from top group by 1),
c as (select source_id, count(*) as rows, count(*) filter (known_at <= t) as eligible, string_agg(distinct unit, ',' order by unit) as units from obs, i group by 1),
f as (select source_id, (epoch_us(any_value(t)) - epoch_us(max(event_time))) / 1000000 as freshness, case when arg_max_null(value, (event_time, event_id)) is null then 1.0 else 0.0 end::double as missing_flag from obs, i where known_at <= t and event_time <= t group by 1)
select source_id, resolved, missing, last_event, rows, eligible, units, freshness, missing_flag from r join c using (source_id) join f using (source_id)"""


def _all() -> dict[str, tuple[Query, str | None]]:
    return resolution.QUERIES | timeseries.QUERIES | evaluation.QUERIES | backtest.QUERIES


def queries() -> dict[str, Query]:
    return {"flagship": flagship} | {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {"flagship": FLAGSHIP_SQL} | {k: s for k, (_, s) in _all().items() if s}
