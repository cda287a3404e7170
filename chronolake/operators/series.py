"""Hourly series: completeness-gated means, exact lags, elapsed windows, as-of lookups and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import micros

HOUR_US = 3_600_000_000


def hour(time: str) -> Column:
    """The start of the hour, of the same type as the column's timestamps without zone."""
    return F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")


def shifted(time: str | Column, hours: int) -> Column:
    col = F.col(time) if isinstance(time, str) else time
    return col + F.make_dt_interval(F.lit(0), F.lit(hours))


def hourly_mean(rows: DataFrame, time: str, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys, hour(time).alias("hour")).agg(*(F.avg(v).alias(v) for v in values))


def complete_hourly_mean(rows: DataFrame, time: str, keys: list[str], value: str, slots: int = 4) -> DataFrame:
    """Hours whose values are exactly one at each of the ``slots`` equal parts of the hour."""
    step = HOUR_US // slots
    own = F.col(value).isNotNull()
    return (
        rows.groupBy(*keys, hour(time).alias("hour"))
        .agg(F.count(value).alias("n"), F.count_distinct(F.when(own & (F.pmod(micros(time), F.lit(step)) == 0), F.col(time))).alias("slots"), F.avg(value).alias(value))
        .where((F.col("n") == slots) & (F.col("slots") == slots))
        .drop("n", "slots")
    )


def pivot_hourly(rows: DataFrame, time: str, key: str, names: list[str], value: str) -> DataFrame:
    """One column for each of the given names: explicit, so no pass is spent on finding them."""
    return rows.groupBy(hour(time).alias("hour")).agg(*(F.avg(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names))


def hour_grid(spark, first: Column, last: Column) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("hour"))


def exact_lag(series: DataFrame, keys: list[str], hours: int, issue: Column | None = None, value: str = "value", name: str | None = None) -> DataFrame:
    """Adds the value exactly ``hours`` earlier, null where there is none or it lies after ``issue``."""
    name = name or f"lag_{hours}"
    past = series.select(*keys, shifted("hour", hours).alias("hour"), F.col(value).alias(name), F.col("hour").alias("_at"))
    if issue is not None:
        past = past.where(F.col("_at") <= issue)
    return series.join(past.drop("_at"), [*keys, "hour"], "left")


def lag_features(series: DataFrame, keys: list[str], lags: list[int], value: str = "value") -> DataFrame:
    """All lags in one shuffle: each row is sent to the hours that it is a lag of, and gathered there."""
    kinds = [0, *lags]
    sent = series.select(*keys, F.explode(F.array(*(F.struct(shifted("hour", k).alias("hour"), F.lit(k).alias("k"), F.col(value).alias("v")) for k in kinds))).alias("x"))
    wide = sent.groupBy(*keys, F.col("x.hour").alias("hour")).agg(F.max(F.col("x.k") == 0).alias("own"), F.max(F.when(F.col("x.k") == 0, F.col("x.v"))).alias(value), *(F.max(F.when(F.col("x.k") == k, F.col("x.v"))).alias(f"lag_{k}") for k in lags))
    # min of k is 0 where the hour itself exists
    return wide.where("own or false").drop("own")


def rolling_from_lags(series: DataFrame, keys: list[str], hours: int, value: str = "value") -> DataFrame:
    """Mean and deviation of the previous ``hours`` hours; null unless all are there."""
    frame = Window.partitionBy(*keys).orderBy(micros("hour")).rangeBetween(-hours * HOUR_US, -HOUR_US)
    full = F.count(value).over(frame) == hours
    return series.select("*", F.when(full, F.avg(value).over(frame)).alias(f"mean_{hours}"), F.when(full, F.stddev_pop(value).over(frame)).alias(f"std_{hours}"))


def elapsed_window(rows: DataFrame, keys: list[str], time: str, hours: int, value: str = "value") -> DataFrame:
    """mean, std, min and max over (t - hours, t]; any null inside gives null.

    Time is cut into blocks of the window's length, so a window is the start of its own block up to t and the end of
    the block before from t - hours on.  A row goes to its own block and, moved by the window's length, to the next:
    the one part runs on forwards, the other backwards, and the two are merged (deviations as Chan, Golub and LeVeque
    do).  No frame is summed anew for a row, and no task sorts the whole history of a key.
    """
    width = hours * HOUR_US
    t = micros(time)
    own = t - F.pmod(t, F.lit(width))
    kinds = F.array_compact(F.array(F.struct(own.alias("b"), t.alias("t"), F.lit(0).alias("moved")), F.when(t.isNotNull(), F.struct((own + width).alias("b"), (t + width).alias("t"), F.lit(1).alias("moved")))))
    sent = rows.withColumn("_x", F.explode(kinds))
    block = Window.partitionBy(*keys, "_x.b")
    # rows of one time are peers; a moved row lies inside only the windows that end before its new time
    frames = (block.orderBy("_x.t").rangeBetween(Window.unboundedPreceding, 0), block.orderBy(F.desc("_x.t"), "_x.moved").rowsBetween(Window.unboundedPreceding, 0))
    parts = {}
    for moved, frame in enumerate(frames):
        here = F.col("_x.moved") == moved
        v = F.when(here, F.col(value))
        parts |= {f"_{k}{moved}": f(x).over(frame) for k, f, x in (("rows", F.count_if, here), ("n", F.count, v), ("mean", F.avg, v), ("var", F.var_pop, v), ("min", F.min, v), ("max", F.max, v))}
    wide = sent.withColumns(parts).where("_x.moved = 0")
    n0, n1, mean0, mean1 = (F.col(c) for c in ("_n0", "_n1", "_mean0", "_mean1"))
    n, full = n0 + n1, n0 + n1 == F.col("_rows0") + F.col("_rows1")
    both = {
        "w_mean": F.when(n1 == 0, mean0).otherwise((n0 * mean0 + n1 * mean1) / n),
        "w_std": F.sqrt(F.when(n1 == 0, F.col("_var0")).otherwise((n0 * F.col("_var0") + n1 * F.col("_var1") + (mean1 - mean0) * (mean1 - mean0) * (n0 * n1 / n)) / n)),
        "w_min": F.least("_min0", "_min1"),
        "w_max": F.greatest("_max0", "_max1"),
    }
    return wide.withColumns({k: F.when(full, c) for k, c in both.items()}).drop("_x", *parts)


def rate_of_change(series: DataFrame, keys: list[str], hours: int, value: str = "value") -> DataFrame:
    """Change per second over exactly ``hours``; null unless both ends are there."""
    wide = exact_lag(series, keys, hours, value=value, name="_past")
    return wide.withColumn("rate", (F.col(value) - F.col("_past")) / F.lit(hours * 3600)).drop("_past")


def freshness(obs: DataFrame, issue: Column) -> DataFrame:
    """Per source: seconds since the latest known event, and whether its value is missing."""
    known = obs.where((F.col("known_at") <= issue) & (F.col("event_time") <= issue))
    top = known.groupBy("source_id").agg(F.max("event_time").alias("last"), F.max_by("value", F.struct("event_time", "event_id")).alias("latest"))
    return top.select("source_id", ((micros(issue) - micros("last")) / 1_000_000).alias("freshness"), F.when(F.col("latest").isNull(), 1.0).otherwise(0.0).alias("missing_flag"))


def calendar(rows: DataFrame, time: str) -> DataFrame:
    from ..functions.scalars import cyclic

    col = F.col(time)
    sine, cosine = cyclic(F.hour(col), 24)
    week_sine, week_cosine = cyclic(F.weekday(col), 7)
    return rows.select(
        "*", F.weekday(col).alias("weekday"), F.hour(col).alias("hour_of_day"), F.month(col).alias("month"), (F.weekday(col) >= 5).alias("weekend"),
        sine.alias("hour_sin"), cosine.alias("hour_cos"), week_sine.alias("weekday_sin"), week_cosine.alias("weekday_cos"),
    )


def value_ramp(series: DataFrame, keys: list[str], lag: int, value: str = "value") -> DataFrame:
    """The value ``lag`` hours before and its change from the hour before that."""
    wide = lag_features(series, keys, [lag, lag + 1], value)
    return wide.select(*keys, "hour", F.col(f"lag_{lag}").alias("value"), (F.col(f"lag_{lag}") - F.col(f"lag_{lag + 1}")).alias("ramp"))


def _squares(mean: Column):
    return lambda a, x: a + (x - mean) * (x - mean)


def feature_vector(series: DataFrame, keys: list[str], lags: tuple[int, ...] = (1, 24, 48, 168), rolling: tuple[int, ...] = (3, 24), value: str = "value") -> DataFrame:
    """keys, hour, lags, ramp, rolling means and deviations of earlier hours, and the calendar: one shuffle.

    A rolling value is null unless all its hours are there.
    """
    back = sorted({*lags, 1, 2, *range(1, max(rolling, default=0) + 1)})
    wide = lag_features(series, keys, back, value)
    parts = []
    for h in rolling:
        own = F.array(*(F.col(f"lag_{k}") for k in range(1, h + 1)))
        full = ~F.exists(own, lambda x: x.isNull())
        mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / h
        parts += [F.when(full, mean).alias(f"mean_{h}"), F.when(full, F.sqrt(F.aggregate(own, F.lit(0.0), _squares(mean)) / h)).alias(f"std_{h}")]
    rows = wide.select(*keys, "hour", *(F.col(f"lag_{k}") for k in lags), (F.col("lag_1") - F.col("lag_2")).alias("ramp_1"), *parts)
    return calendar(rows, "hour")


def window_sum(events: DataFrame, issues: DataFrame, keys: list[str], hours: int, time: str = "known_at", value: str = "value") -> DataFrame:
    """Sum of values over [issue - hours, issue] for each issue: an equality join on blocks of the window's length.

    An event meets the issues of its own block and the next one, so no pair further apart than two windows is made.
    """
    width = hours * HOUR_US
    block = lambda c: F.floor(micros(c) / width)
    sent = events.select(*keys, micros(time).alias("_t"), F.col(value).alias("_v"), F.explode(F.array(block(time), block(time) + 1)).alias("_b"))
    asked = issues.select(*keys, "issue", micros("issue").alias("_i"), block("issue").alias("_b"))
    inside = asked.join(sent, [*keys, "_b"], "left").withColumn("_v", F.when((F.col("_t") <= F.col("_i")) & (F.col("_t") >= F.col("_i") - width), F.col("_v")))
    return inside.groupBy(*keys, "issue").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("window_sum"))


def latest_before(events: DataFrame, issues: DataFrame, keys: list[str], time: str = "known_at", value: str = "value") -> DataFrame:
    """For each issue the latest event at or before it, of several at once that with the highest value.

    Events and issues of a day are sorted together; the last event of the days before is carried over, so no task
    sorts the whole history of a key.
    """
    day = lambda c: F.floor(micros(c) / (24 * HOUR_US))
    e = events.select(*keys, F.col(time).alias("at"), F.lit(0).alias("kind"), F.struct(F.col(time).alias("event_at"), F.col(value).alias("value")).alias("event"))
    i = issues.select(*keys, F.col("issue").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(e.schema["event"].dataType).alias("event"))
    both = e.unionByName(i).withColumn("_d", day("at"))
    tops = both.groupBy(*keys, "_d").agg(F.max("event").alias("_top"))
    carried = tops.select(*keys, "_d", F.last("_top", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    past = Window.partitionBy(*keys, "_d").orderBy("at", "kind", "event").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("event", ignorenulls=True).over(past)).where("kind = 1").join(carried, [*keys, "_d"])
    got = found.withColumn("event", F.coalesce("_own", "_carried"))
    return got.select(*keys, F.col("at").alias("issue"), F.col("event.event_at").alias("event_at"), F.col("event.value").alias("value"))


FALLBACK_HOURS = (168, 167, 169, 336)


def seasonal_fallback(targets: DataFrame, series: DataFrame, keys: list[str], issue: Column) -> DataFrame:
    """Value a week before, else near it, else two weeks before, else the latest known; with the name of the source.

    ``targets``: keys and hour; ``series``: keys, hour, value.
    """
    known = series.where((F.col("hour") <= issue) & F.col("value").isNotNull())
    sent = known.select(*keys, F.explode(F.array(*(F.struct(shifted("hour", k).alias("hour"), F.lit(k).alias("k")) for k in FALLBACK_HOURS))).alias("x"), "value")
    near = sent.groupBy(*keys, F.col("x.hour").alias("hour")).agg(*(F.max(F.when(F.col("x.k") == k, F.col("value"))).alias(f"v{k}") for k in FALLBACK_HOURS))
    last = known.groupBy(*keys).agg(F.max_by("value", "hour").alias("latest"))
    names = {168: "exact_168h", 167: "nearby_167h", 169: "nearby_169h", 336: "previous_week_336h"}
    rows = targets.join(near, [*keys, "hour"], "left").join(last, keys, "left")
    value = F.coalesce(*(F.col(f"v{k}") for k in FALLBACK_HOURS), "latest")
    label = reduce(lambda w, k: w.when(F.col(f"v{k}").isNotNull(), names[k]), FALLBACK_HOURS, F).otherwise(F.when(F.col("latest").isNotNull(), "latest_causal"))
    return rows.select(*keys, "hour", value.alias("value"), label.alias("label"))


def long_lead_median(targets: DataFrame, series: DataFrame, keys: list[str], lags: tuple[int, ...] = (504, 672, 840)) -> DataFrame:
    """Median of the lags that exist."""
    from ..functions.scalars import array_quantile

    sent = series.where("value is not null").select(*keys, F.explode(F.array(*(shifted("hour", k) for k in lags))).alias("hour"), "value")
    got = sent.groupBy(*keys, "hour").agg(F.collect_list("value").alias("vs"))
    return targets.join(got, [*keys, "hour"], "left").select(*keys, "hour", array_quantile(F.col("vs"), 0.5).alias("value"))


def long_lead_fallback(targets: DataFrame, series: DataFrame, keys: list[str], lags: tuple[int, ...] = (504, 672, 840)) -> DataFrame:
    """Where ``seasonal_fallback`` had only the latest value left, the median of the long lags that exist instead."""
    median = long_lead_median(targets, series, keys, lags).withColumnRenamed("value", "_median")
    rows = targets.join(median, [*keys, "hour"])
    return rows.withColumn("value", F.when(F.col("label") == "latest_causal", F.coalesce("_median", "value")).otherwise(F.col("value"))).drop("_median")


def label_histogram(rows: DataFrame, label: str, names: list[str]) -> DataFrame:
    """Rows of each name, 0 for names that do not occur."""
    counts = rows.agg(*(F.count_if(F.col(label) == n).alias(f"_{i}") for i, n in enumerate(names)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias(label), F.col(f"_{i}").alias("rows")) for i, n in enumerate(names)))).alias("x")).select("x.*")


def complete_hours(rows: DataFrame, time: str, slots: int = 4) -> DataFrame:
    """Hours with one row at each part of the hour, whatever its values: an index of rows, not of values."""
    n = F.count_distinct(F.floor(F.pmod(micros(time), F.lit(HOUR_US)) / (HOUR_US // slots)))
    return rows.groupBy(hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("rows"), n.alias("_s")).where((F.col("rows") == slots) & (F.col("_s") == slots)).drop("_s")


def snapshot(obs: DataFrame, issues: DataFrame, sources: list[str], stale_hours: float = 3.0) -> DataFrame:
    """Per issue: value, missing, stale and freshness of each source, hour and weekday, in one wide row."""
    grid = issues.select("issue", F.explode(F.array(*(F.lit(s) for s in sources))).alias("source_id"))
    known = obs.withColumn("at", F.greatest("known_at", "event_time"))
    latest = latest_before(known, grid, ["source_id"], "at")
    age = (micros("issue") - micros("event_at")) / 1_000_000
    parts = []
    for s in sources:
        own = F.col("source_id") == s
        parts += [F.max(F.when(own, F.coalesce("value", F.lit(0.0)))).alias(f"{s}_value"), F.max(F.when(own, F.when(F.col("value").isNull(), 1.0).otherwise(0.0))).alias(f"{s}_missing"), F.max(F.when(own, F.when(age > stale_hours * 3600, 1.0).otherwise(0.0))).alias(f"{s}_stale"), F.max(F.when(own, F.coalesce(age, F.lit(9999.0)))).alias(f"{s}_freshness")]
    return latest.groupBy("issue").agg(*parts).select("*", F.hour("issue").alias("hour_of_day"), F.weekday("issue").alias("weekday"))


def standard_scale(rows: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Centres and scales columns by the training rows' mean and deviation; a deviation of 0 counts as 1."""
    fit = rows.where(train).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    scaled = {c: (F.col(c) - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c in columns}
    return rows.withColumns(scaled)


def fit_scale(train: DataFrame, value: str, cutoff: Column, *keys: str, id: str = "event_id") -> DataFrame:
    """keys, m, s, fitted_at and sources of a scaler. Refused: rows of another partition, rows known or dated after the
    cutoff, and repeated ids."""
    from ..guards import refuse_if_any, require_unique

    late = (F.col("known_at") > cutoff) | (F.col("event_time") > cutoff)
    require_unique(refuse_if_any(train, other_partition=~F.col("partition").eqNullSafe(F.lit("train")), after_the_cutoff=late), id)
    sd = F.coalesce(F.nullif(F.stddev_pop(value), F.lit(0.0)), F.lit(1.0))
    return train.groupBy(*keys).agg(F.avg(value).alias("m"), sd.alias("s"), F.first(cutoff).alias("fitted_at"), F.array(F.concat_ws(":", *keys, F.lit("fit"))).alias("fit_sources"))


def apply_scale(rows: DataFrame, fit: DataFrame, value: str, *keys: str) -> DataFrame:
    """Scaled values with their lineage: known when both the row and the fit are, from the sources of both."""
    joined = rows.join(fit, list(keys))
    return joined.withColumns({value: (F.col(value) - F.col("m")) / F.col("s"), "known_at": F.greatest("known_at", "fitted_at"), "sources": F.array_sort(F.array_union("sources", "fit_sources"))}).drop("m", "s", "fitted_at", "fit_sources")


def refuse_repeated_times(rows: DataFrame, time: str, *keys: str) -> DataFrame:
    """Refuses two eligible events of one key at one time."""
    from ..guards import require_unique

    return require_unique(rows, *keys, time)
