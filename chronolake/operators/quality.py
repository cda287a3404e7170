"""Audits of an observation table: cadence, gaps, missingness, duplicates, revisions, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def missingness(obs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    missing = F.count_if(F.col("value").isNull())
    return obs.groupBy("source_id").agg(n.alias("rows"), missing.alias("missing"), (missing / n).alias("fraction"))


def duplicates(obs: DataFrame, *identity: str) -> DataFrame:
    """Groups of equal identity and the rows after the first, in one row."""
    many = obs.groupBy(*identity).count().where("count > 1")
    return many.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def revisions(obs: DataFrame) -> DataFrame:
    """Per source: logical series, revised ones, and revision rows after the first."""
    series = obs.groupBy("source_id", "source_record_id").agg(F.count_distinct("revision_sequence").alias("k"))
    return series.groupBy("source_id").agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("k") > 1).alias("revised_series"), F.sum(F.col("k") - 1).alias("revision_rows"))


def units(obs: DataFrame) -> DataFrame:
    """Units of each source, and whether there is one."""
    found = F.sort_array(F.collect_set("unit"))
    return obs.groupBy("source_id").agg(F.array_join(found, ",").alias("units"), (F.size(found) == 1).alias("consistent"))


def gaps(obs: DataFrame) -> DataFrame:
    """source_id, event_time, next_time and gap_us between distinct event times.

    The window runs per source and day block: the last time of each block is carried to the next, so a source
    with a third of all rows is not sorted by one task.
    """
    times = obs.select("source_id", "event_time").distinct().withColumn("block", F.to_date("event_time"))
    inside = Window.partitionBy("source_id", "block").orderBy("event_time")
    firsts = times.groupBy("source_id", "block").agg(F.min("event_time").alias("first"))
    carried = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("source_id").orderBy("block"))).select("source_id", "block", "after")
    nexts = times.withColumn("inner_next", F.lead("event_time").over(inside)).join(carried, ["source_id", "block"])
    out = nexts.select("source_id", "event_time", F.coalesce("inner_next", "after").alias("next_time"))
    return out.withColumn("gap_us", micros("next_time") - micros("event_time"))


def cumulative(counts: DataFrame, value: str, n: str, *keys: str, bins: int = 1024) -> DataFrame:
    """Adds ``below``: the rows of a key with a smaller value. ``counts``: a row for each distinct value and its count.

    Values are cut into bins of equal width between a key's least and greatest; counts are summed over bins first, so
    a key with most of the rows is ranked by as many tasks as it has bins.
    """
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0).cast("int")
    binned = counts.join(ends, list(keys)).withColumn("_bin", place).drop("_lo", "_hi")
    before = lambda *part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_k")).withColumn("_start", F.coalesce(F.sum("_k").over(before(*keys, order="_bin")), F.lit(0))).drop("_k")
    inside = F.coalesce(F.sum(n).over(before(*keys, "_bin", order=value)), F.lit(0))
    return binned.join(starts, [*keys, "_bin"]).withColumn("below", F.col("_start") + inside).drop("_bin", "_start")


def quantiles(df: DataFrame, value: str, probabilities: list[float], *keys: str) -> DataFrame:
    """``q``: exact linear quantiles of the values that are set, by key, in the order of ``probabilities``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative(counts, "_v", "_n", *keys).join(counts.groupBy(*keys).agg(F.sum("_n").alias("_all")), list(keys))
    parts = []
    for p in probabilities:
        at = (F.col("_all") - 1) * F.lit(float(p))
        own = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("_n")), F.col("_v")))
        parts.append(F.struct(own(F.floor(at)).alias("a"), own(F.ceil(at)).alias("b"), F.max(at - F.floor(at)).alias("w")))
    return ranked.groupBy(*keys).agg(*(x.alias(f"_q{i}") for i, x in enumerate(parts))).select(*keys, F.array(*(F.col(f"_q{i}.a") + (F.col(f"_q{i}.b") - F.col(f"_q{i}.a")) * F.col(f"_q{i}.w") for i in range(len(parts)))).alias("q"))


def cadence(obs: DataFrame) -> DataFrame:
    """Median gap of each source in seconds."""
    return quantiles(gaps(obs).where("gap_us > 0"), "gap_us", [0.5], "source_id").select("source_id", (F.col("q")[0] / MICROS).alias("median_seconds"))


def long_gaps(obs: DataFrame, times: float) -> DataFrame:
    """Gaps longer than ``times`` the source's median."""
    found = gaps(obs).where("gap_us > 0")
    median = quantiles(found, "gap_us", [0.5], "source_id").select("source_id", F.col("q")[0].alias("median"))
    return found.join(median, "source_id").where(F.col("gap_us") > F.lit(times) * F.col("median")).select("source_id", "event_time", "next_time", (F.col("gap_us") / MICROS).alias("gap_seconds"))


def authorised(rows: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is among the allowed ones."""
    return rows.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def stale_sources(obs: DataFrame, issue: Column, times: float = 2.0) -> DataFrame:
    """Per source: whether the time since its latest known event exceeds ``times`` its cadence."""
    last = obs.where(F.col("known_at") <= issue).groupBy("source_id").agg(F.max("event_time").alias("last_event"))
    age = (micros(issue) - micros("last_event")) / MICROS
    return cadence(obs).join(last, "source_id").select("source_id", "last_event", age.alias("age_seconds"), (age > F.lit(times) * F.col("median_seconds")).alias("stale"))


def future_availability(obs: DataFrame, issue: Column) -> DataFrame:
    """Rows known at ``issue`` about a later event."""
    return obs.groupBy("source_id").agg(F.count_if((F.col("known_at") <= issue) & (F.col("event_time") > issue)).alias("future_rows"))


def horizon_matrix(obs: DataFrame, issue: Column, hours: list[int], time: Column) -> DataFrame:
    """For each source and horizon, whether any row about that hour was known. One pass; horizons are columns first."""
    lead = (micros(time) - micros(issue)) / (3600 * MICROS)
    wide = obs.groupBy("source_id").agg(*(F.coalesce(F.bool_or((F.col("known_at") <= issue) & (lead == h)), F.lit(False)).alias(f"h{h}") for h in hours))
    return wide.select("source_id", F.explode(F.array(*(F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(f"h{h}").alias("available")) for h in hours))).alias("x")).select("source_id", "x.*")


def coverage(obs: DataFrame, issue: Column) -> DataFrame:
    known = F.count_if(F.col("known_at") <= issue)
    return obs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("event_time").alias("event_times"), known.alias("eligible"),
        (known / F.count(F.lit(1))).alias("eligible_fraction"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
        F.array_join(F.sort_array(F.collect_set("unit")), ",").alias("units"),
    )


def flags(obs: DataFrame, issue: Column, max_age_seconds: float, least: float, most: float, identity: tuple[str, ...]) -> DataFrame:
    """Adds ``flags``, a joined list. Repeated identities are found by aggregation and joined, not by a window."""
    many = obs.groupBy(*identity).count().where("count > 1").select(*identity, F.lit(True).alias("_many"))
    rows = obs.join(many, list(identity), "left")
    age = (micros(issue) - micros("event_time")) / MICROS
    named = {
        "MISSING": F.col("value").isNull(), "STALE": age > max_age_seconds, "REVISED": F.col("revision_sequence") > 0, "DUPLICATE": F.col("_many").isNotNull(),
        "OUT_OF_RANGE": ~F.col("value").between(least, most), "UNAVAILABLE_AT_ISSUE": F.col("known_at") > issue,
    }
    return rows.withColumn("flags", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items()))), ",")).drop("_many")


def timestamp_hygiene(rows: DataFrame, text: str) -> DataFrame:
    """Per source: times that do not parse, times without offset, and whether offsets are mixed."""
    from ..functions.scalars import offset_of

    col = F.col(text)
    return rows.groupBy("source_id").agg(
        F.count_if(F.try_to_timestamp(col).isNull() & col.isNotNull()).alias("unparseable"),
        F.count_if(F.try_to_timestamp(col).isNotNull() & offset_of(col).isNull()).alias("naive"),
        (F.count_distinct(offset_of(col)) > 1).alias("mixed_offsets"),
    )


def audit(obs: DataFrame, issue: Column, hours: list[int]) -> dict[str, list]:
    """All parts of the audit as rows by source: a report of bounded size."""
    parts = {
        "coverage": coverage(obs, issue), "missingness": missingness(obs), "revisions": revisions(obs), "units": units(obs), "cadence": cadence(obs),
        "stale": stale_sources(obs, issue), "future": future_availability(obs, issue), "horizons": horizon_matrix(obs, issue, hours, F.col("event_time")),
        "duplicates": duplicates(obs, "source_id", "source_record_id", "revision_sequence"),
    }
    return {name: [r.asDict() for r in df.collect()] for name, df in parts.items()}
