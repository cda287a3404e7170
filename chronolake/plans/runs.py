"""End-to-end runs: from observations over folds and candidates to champions, joint rows and an artifact bundle."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..guards import Refused
from ..operators import models, oof, pit, quality, series, splits
from ..sources.readers import synthetic
from ..sources.sinks import content_hash, write_bundle
from .serving import forecast_document, histogram_document, readiness


def supervised(hours: DataFrame, targets: list[str], horizon: int = 1) -> DataFrame:
    """Samples of each target (target_name, hour, value): a row for each issue hour whose label exists and at which
    all targets have one.  Features are hour of day, the value at issue time and its lags."""
    wide = series.lag_features(hours.where(F.col("target_name").isin(*targets)), ["target_name"], [1, 24])
    ahead = F.make_dt_interval(F.lit(0), F.lit(horizon))
    rows = wide.join(hours.select("target_name", (F.col("hour") - ahead).alias("hour"), F.col("value").alias("target")), ["target_name", "hour"])
    whole = rows.where("target is not null").groupBy("hour").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(targets)).select("hour")
    features = F.array(F.hour("hour").cast("double"), *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("value", "lag_1", "lag_24")))
    return rows.join(whole, "hour").select("target_name", F.date_format("hour", "yyyyMMddHH").alias("row_id"), F.col("hour").alias("issue_time"), (F.col("hour") + ahead).alias("target_time"), F.col("hour").alias("feature_known_at"), (F.col("hour") + ahead).alias("label_known_at"), F.hour("hour").alias("hod"), F.col("value").alias("now_value"), "target", features.alias("features"))


def scenario(assigned: DataFrame, season: int, fitted: dict | None = None) -> DataFrame:
    """Evidence of baselines and fitted models for every fold and target."""
    out = oof.point_candidates(assigned, season, "hod", "target_name")
    for name, make in (fitted or {"ridge": models.Ridge, "boosted": models.BoostedTrees}).items():
        out = out.unionByName(models.fitted(assigned, name, make, "target_name"))
    return out


def backtest(assigned: DataFrame, targets: list[str], season: int = 24, fitted: dict | None = None) -> dict[str, DataFrame]:
    """evidence, fold_scores, summary, champions and joint rows of one scenario."""
    evidence = models.eligible(scenario(assigned, season, fitted), "target_name")
    scores = models.scoreboard(evidence, "fold_id", "target_name", "model_id")
    summary = models.fold_summary(scores, "target_name", "model_id", metrics=("mae", "rmse", "bias"))
    champions = oof.champions(summary, "target_name")
    return {"evidence": evidence, "fold_scores": scores, "summary": summary, "champions": champions, "joint": oof.joint(oof.selected(evidence, champions, "target_name"), "target_name", targets)}


def family_gains(base: DataFrame, candidate: DataFrame, family: str) -> DataFrame:
    """Gain of each target and model from a family of features: summaries without and with it."""
    both = base.select("target_name", "model_id", F.col("mae_mean").alias("base_mae")).join(candidate.select("target_name", "model_id", F.col("mae_mean").alias("candidate_mae")), ["target_name", "model_id"])
    return both.select(F.lit(family).alias("feature_family"), "*", (F.col("base_mae") - F.col("candidate_mae")).alias("mae_gain"))


def run_champion(obs: DataFrame, issue: datetime, plan: splits.Plan, targets: list[str], folder: str, *, config: dict | None = None, horizon_hours: int = 1, progress=None) -> dict:
    """Audit, readiness, backtest and a bundle of artifacts for the first target; returns them with timings.

    A run that is not ready is refused.  The forecast's samples are the champion's last prediction plus its
    out-of-fold residuals.
    """
    took: dict[str, float] = {}
    begun = time.perf_counter()

    def done(stage: str) -> None:
        nonlocal begun
        took[stage], begun = round(time.perf_counter() - begun, 3), time.perf_counter()
        if progress:
            progress(stage)

    at: Column = F.lit(issue.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    report = readiness(quality.audit(obs, at, [1, 24]), config or {}, targets)
    if not report.ready:
        raise Refused("not ready: " + ", ".join(n for n, (s, _) in report.checks.items() if s == "FAIL"))
    done("readiness")
    hourly = pit.as_of(obs, at).groupBy(F.col("source_id").alias("target_name"), series.hour("event_time").alias("hour")).agg(F.avg("value").alias("value"))
    assigned = splits.assign(supervised(hourly, targets, horizon_hours), plan)
    found = backtest(assigned, targets)
    board = [r.asDict() for r in found["summary"].orderBy("target_name", "mae_mean", "model_id").collect()]
    champions = {r["target_name"]: r["model_id"] for r in found["champions"].collect()}
    done("backtest")
    first = targets[0]
    rows = found["joint"].select("timestamp", F.col(f"{first}_pred").alias("p"), F.col(f"{first}_residual").alias("r")).orderBy("timestamp").collect()  # a row for each validation hour
    samples = [round(rows[-1]["p"] + r["r"]) for r in rows]
    zoned = issue if issue.tzinfo else issue.replace(tzinfo=timezone.utc)
    forecast = forecast_document(content_hash({"target": first, "issue": zoned.isoformat()})[:16], first, zoned, horizon_hours * 3600, samples) | {
        "model_id": champions[first], "unit": "MW", "sign_convention": "positive is export", "fit_cutoff": zoned.isoformat(), "fold_summary": {"folds": len(plan.folds()), "oof_rows": len(rows), "holdout_used": False},
    }
    evidence = oof.set_hash(assigned.where("partition = 'train'").select("row_id", "target_name", "target"), ["row_id", "target_name", "target"]).first()["hash"]
    provenance = {
        "fallback": False, "abstained": False, "as_of_policy": "known_at <= issue", "source_ids": targets, "dataset_manifest_id": evidence, "feature_manifest_id": content_hash(["hod", "value", "lag_1", "lag_24"]),
        "training_data_hash": evidence, "fit_cutoff": zoned.isoformat(), "pit_ready": True, "errors": [],
    }
    scoreboard = {"selected_model": champions[first], "candidates": {b["model_id"]: {k: v for k, v in b.items() if k not in ("model_id", "target_name")} for b in board if b["target_name"] == first}}
    manifest = write_bundle(folder, {"forecast.json": forecast, "histogram.json": histogram_document(forecast), "scoreboard.json": scoreboard, "provenance.json": provenance})
    done("artifacts")
    return {"champions": champions, "scoreboard": board, "manifest": manifest, "seconds": took, "joint": found["joint"]}


def run_synthetic(spark: SparkSession, folder: str, seed: int = 0, days: int = 30) -> dict:
    """``run_champion`` on synthetic sources: the whole way without any input."""
    first = datetime(2024, 1, 1)
    obs = synthetic(spark, first.isoformat(sep=" "), days * 24, seed)
    plan = splits.Plan(first + timedelta(days=10), first + timedelta(days=days - 3), timedelta(days=9), timedelta(days=1), timedelta(0), timedelta(days=5), timedelta(hours=1), timedelta(0), timedelta(hours=1))
    return run_champion(obs.withColumn("event_id", F.monotonically_increasing_id()), first + timedelta(days=days), plan, ["net_position", "load"], folder)
