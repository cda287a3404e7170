"""Rolling-origin folds, weekly folds and holdout."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..guards import Refused


@dataclass(frozen=True)
class Plan:
    """Origins and lengths of a rolling-origin split."""

    first: datetime
    holdout: datetime
    train: timedelta
    validation: timedelta
    calibration: timedelta
    step: timedelta
    purge: timedelta = timedelta(0)
    embargo: timedelta = timedelta(0)
    label_delay: timedelta = timedelta(0)

    def folds(self) -> list[dict]:
        """Interval bounds of every fold before the holdout."""
        out, origin = [], self.first
        while origin + self.validation + self.embargo + self.calibration <= self.holdout:
            val_end = origin + self.validation
            cal_start = val_end + self.embargo
            cal_end = cal_start + self.calibration
            cutoff = origin - self.purge
            out.append({"fold_id": len(out), "train_start": cutoff - self.train, "train_end": cutoff, "label_cutoff": cutoff - self.label_delay, "val_start": origin, "val_end": val_end, "cal_start": cal_start, "cal_end": cal_end, "holdout": self.holdout})
            origin = max(origin + self.step, cal_end + self.embargo + self.purge + self.label_delay)
        return out


def assign(samples: DataFrame, plan: Plan) -> DataFrame:
    """samples with fold_id and partition; a sample may be in several folds.

    The plan's folds are few and become one literal array: each row unfolds to its own folds, nothing is joined.
    """
    kind = samples.schema["issue_time"].dataType
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast(kind)
    issue, target, label, feature = (F.col(c) for c in ("issue_time", "target_time", "label_known_at", "feature_known_at"))
    choices = []
    for f in plan.folds():
        before = lambda end, f=f: (target < at(end)) & (target < at(f["holdout"]))
        part = (
            F.when((issue >= at(f["train_start"])) & (issue < at(f["train_end"])) & before(f["train_end"]) & (label <= at(f["label_cutoff"])) & (feature <= issue), "train")
            .when((issue >= at(f["val_start"])) & (issue < at(f["val_end"])) & before(f["val_end"]), "validation")
            .when((issue >= at(f["cal_start"])) & (issue < at(f["cal_end"])) & before(f["cal_end"]), "calibration")
        )
        choices.append(F.when(part.isNotNull(), F.struct(F.lit(f["fold_id"]).alias("fold_id"), part.alias("partition"))))
    if not choices:
        raise Refused("the plan has no fold before its holdout")
    return samples.withColumn("_f", F.explode(F.array_compact(F.array(*choices)))).select(*samples.columns, "_f.fold_id", "_f.partition")


def holdout(samples: DataFrame, start: Column) -> DataFrame:
    return samples.where(F.col("issue_time") >= start)


def weekly_folds(hours: DataFrame, train_hours: int, forecast_hours: int, stride_hours: int, most: int | None = None) -> DataFrame:
    """fold_start, forecast_start and rows of complete contiguous folds; ``hours`` has distinct column ``hour``.

    A fold is complete if all its hours exist: counted with one window over hour numbers, not a join per fold.
    """
    span = train_hours + forecast_hours
    n = F.unix_micros(F.col("hour").cast("timestamp")) / 3_600_000_000
    rows = hours.select("hour", n.cast("bigint").alias("n"))
    first = rows.agg(F.min("n")).first()[0]
    if first is None:
        return rows.select(F.col("hour").alias("fold_start"), F.col("hour").alias("forecast_start"), F.lit(0).cast("bigint").alias("rows")).limit(0)
    # each hour belongs to the folds that start up to span - 1 hours earlier
    last = F.floor((F.col("n") - first) / stride_hours)
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("n") - first - span + 1) / stride_hours))
    own = rows.withColumn("fold", F.explode(F.sequence(low, F.greatest(low, last)))).where((F.col("n") >= first + F.col("fold") * stride_hours) & (F.col("n") < first + F.col("fold") * stride_hours + span))
    full = own.groupBy("fold").agg(F.min("hour").alias("fold_start"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") == span)
    out = full.select("fold_start", (F.col("fold_start") + F.make_dt_interval(F.lit(0), F.lit(train_hours))).alias("forecast_start"), "rows")
    return out.orderBy("fold_start").limit(most) if most else out


def position_folds(hours: DataFrame, first_forecast: Column, weeks: int, train_hours: int = 672, week: int = 168) -> DataFrame:
    """hour, fold and part by position among observed hours: the training hours are those just before each week."""
    ranked = hours.withColumn("r", F.row_number().over(Window.orderBy("hour")))  # one row for each hour of the calendar
    start = ranked.where(F.col("hour") >= first_forecast).agg(F.min("r").alias("r0"))
    rows = ranked.crossJoin(F.broadcast(start)).withColumn("d", F.col("r") - F.col("r0"))
    parts = F.array_compact(F.array(*(F.when((F.col("d") >= k * week) & (F.col("d") < (k + 1) * week), F.struct(F.lit(k + 1).alias("fold"), F.lit("forecast").alias("part"))).when((F.col("d") < k * week) & (F.col("d") >= k * week - train_hours), F.struct(F.lit(k + 1).alias("fold"), F.lit("train").alias("part"))) for k in range(weeks))))
    return rows.select("hour", F.explode(parts).alias("f")).select("hour", "f.fold", "f.part")


def check_weekly(rows: DataFrame, week: int = 168, *keys: str) -> DataFrame:
    """Folds whose forecast does not have one issue time and horizons 1 to ``week``, each once."""
    seen = rows.groupBy(*(keys or ("fold_id",))).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("issue_time").alias("issues"), F.count_distinct("horizon").alias("horizons"), F.min("horizon").alias("low"), F.max("horizon").alias("high"))
    return seen.where(~((F.col("rows") == week) & (F.col("issues") == 1) & (F.col("horizons") == week) & (F.col("low") == 1) & (F.col("high") == week)))


def precheck(samples: DataFrame) -> DataFrame:
    """Refuses repeated row ids, and samples that are assigned already."""
    from ..guards import require_unique

    if "partition" in samples.columns and not samples.where("partition is not null").isEmpty():
        raise Refused("samples are assigned to a partition already")
    return require_unique(samples, "row_id")


def warm_start_folds(hours: DataFrame, first_forecast: Column, weeks: int, train_hours: int = 672, week: int = 168) -> DataFrame:
    """``position_folds`` whose weeks end where the first forecast begins."""
    ranked = hours.withColumn("r", F.row_number().over(Window.orderBy("hour")))  # one row for each hour of the calendar
    first = ranked.where(F.col("hour") >= first_forecast).agg(F.min("r").alias("r0"))
    start = ranked.join(F.broadcast(first), F.col("r") == F.col("r0") - weeks * week).select("hour").first()
    if start is None:
        raise Refused(f"fewer than {weeks} weeks before the first forecast")
    return position_folds(hours, F.lit(start["hour"]), weeks, train_hours, week)


def history_hours(weeks: int, train_hours: int = 672, week: int = 168, longest_lag: int = 840) -> dict[str, int]:
    """Hours that a run of ``weeks`` folds needs before and after its first forecast."""
    return {"before": train_hours + longest_lag, "after": weeks * week, "total": train_hours + longest_lag + weeks * week}


def require_history(hours: DataFrame, first_forecast: Column, weeks: int, **lengths: int) -> None:
    """Refuses a series that is too short, naming what is missing."""
    need = history_hours(weeks, **lengths)
    got = hours.agg(F.count_if(F.col("hour") < first_forecast).alias("before"), F.count_if(F.col("hour") >= first_forecast).alias("after")).first()
    short = [f"{k}: {got[k]} hours, {need[k]} needed" for k in ("before", "after") if got[k] < need[k]]
    if short:
        raise Refused("; ".join(short))


def nested_weeks(rows: DataFrame, fit: int, calibrate: int) -> DataFrame:
    """Adds ``part``: the first weeks fit, the next ones calibrate, the others are for show. ``rows`` has week, from 0."""
    return rows.withColumn("part", F.when(F.col("week") < fit, "fit").when(F.col("week") < fit + calibrate, "calibrate").otherwise("demo"))


def origin_weeks(spark: SparkSession, issue: datetime, weeks: int = 12, week: int = 168) -> DataFrame:
    """week, issue_time, horizon and target_time of consecutive fixed-origin weeks that end at ``issue``."""
    grid = spark.range(weeks * week).select((F.col("id") / week).cast("int").alias("week"), (F.col("id") % week + 1).cast("int").alias("horizon"))
    origin = F.lit(issue - timedelta(hours=weeks * week)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("week") * week).cast("int"))
    return grid.select("week", origin.alias("issue_time"), "horizon", (origin + F.make_dt_interval(F.lit(0), F.col("horizon"))).alias("target_time"))
