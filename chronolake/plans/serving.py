"""Readiness, acceptance, forecast documents and the service that reads them: small documents, driver only."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import available_timezones

from ..guards import Refused
from ..sources.sinks import content_hash, load_bundle

#: States of a response, the strongest first.
STATES = ("ABSTAIN", "FALLBACK", "DEGRADED", "NORMAL")


def quantile(values: list[float], p: float) -> float:
    s = sorted(values)
    at = (len(s) - 1) * p
    low = int(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def forecast_document(forecast_id: str, target: str, issue: datetime, horizon_seconds: int, samples: list[int], levels: tuple[float, ...] = (0.1, 0.5, 0.9), fit_cutoff: datetime | None = None) -> dict:
    """A forecast as a document. Horizons are whole seconds, so that any length survives a round trip."""
    if fit_cutoff is not None and fit_cutoff > issue:
        raise Refused("fitted after the issue time")
    if not samples or any(isinstance(s, bool) or not isinstance(s, int) for s in samples) or horizon_seconds <= 0:
        raise Refused("samples must be integers and the horizon positive")
    q = [quantile(samples, p) for p in levels]
    repaired = [max(q[: i + 1]) for i in range(len(q))]
    return {
        "schema": "forecast.v1", "forecast_id": forecast_id, "target": target, "issue_time": issue.isoformat(), "horizon_seconds": horizon_seconds,
        "target_time": (issue + timedelta(seconds=horizon_seconds)).isoformat(), "levels": list(levels), "quantiles": repaired, "quantile_repair_applied": repaired != q,
        "export_probability": sum(s >= 0 for s in samples) / len(samples), "samples": samples,
    }


def histogram_document(forecast: dict, bins: int = 20) -> dict:
    s = forecast["samples"]
    low, high = min(s), max(s)
    width = (high - low) / bins or 1.0
    counts = [0] * bins
    for v in s:
        counts[min(bins - 1, int((v - low) / width))] += 1
    return {"forecast_id": forecast["forecast_id"], "edges": [low + i * width for i in range(bins + 1)], "probabilities": [c / len(s) for c in counts]}


@dataclass
class Report:
    """Named checks with PASS, WARNING or FAIL."""

    checks: dict[str, tuple[str, str]] = field(default_factory=dict)

    def add(self, name: str, ok: bool, detail: str = "", warn: bool = False) -> None:
        self.checks[name] = ("PASS" if ok else "WARNING" if warn else "FAIL", detail)

    @property
    def ready(self) -> bool:
        return all(s != "FAIL" for s, _ in self.checks.values())


def placeholder(value) -> bool:
    return value is None or (isinstance(value, str) and (not value.strip() or value.startswith("<") or value.startswith("REPLACE_")))


#: Fields of a target's contract.
CONTRACT = ("target_name", "target_entity", "unit", "sign_convention", "resolution_seconds", "forecast_issue_time", "target_valid_time", "horizon_seconds", "aggregation_rule", "label_availability_rule", "forecast_type", "evaluation_metrics")
CANDIDATES = ("persistence", "seasonal_persistence", "historical_conditional", "ridge", "boosted")


def writable(folder: str) -> bool:
    """Whether a folder, or the nearest one above it that exists, can be written to."""
    path = os.path.abspath(folder)
    while not os.path.exists(path):
        path = os.path.dirname(path)
    return os.path.isdir(path) and os.access(path, os.W_OK)


def readiness(audit: dict, config: dict, expected: list[str]) -> Report:
    """Rules over a collected audit and the run's configuration; parts that the configuration leaves out are not asked.

    Checks that fail stop a run; those that only warn ask for a look.
    """
    out = Report()
    cover = {r["source_id"]: r for r in audit["coverage"]}
    given = lambda *keys: any(k in config for k in keys)
    target = config.get("target", {})
    out.add("config complete", not [k for k, v in config.items() if placeholder(v)])
    if given("target"):
        unset = [k for k in CONTRACT if placeholder(target.get(k))]
        out.add("target contract resolved", not unset, ", ".join(unset))
        out.add("target units resolved", not placeholder(target.get("unit")), str(target.get("unit")))
        out.add("sign convention resolved", not placeholder(target.get("sign_convention")), str(target.get("sign_convention")))
    if given("columns"):
        out.add("target column exists", not placeholder(config["columns"].get("value")))
    out.add("expected sources", not set(expected) - set(cover), ", ".join(sorted(set(expected) - set(cover))))
    out.add("dataset date range", any(r["rows"] for r in cover.values()))
    out.add("eligible rows", all(r["eligible"] > 0 for r in cover.values()))
    out.add("consistent units", all(r["consistent"] for r in audit["units"]))
    out.add("cadence", any(r["median_seconds"] for r in audit["cadence"]), warn=True)
    out.add("no duplicates", all(r["duplicate_rows"] == 0 for r in audit["duplicates"]))
    out.add("fresh sources", not any(r["stale"] for r in audit["stale"]), warn=True)
    out.add("gaps", not any(r["stale"] for r in audit["stale"]), warn=True)
    out.add("missing values", all(r["fraction"] <= 0.5 for r in audit["missingness"]), warn=True)
    out.add("no future events", all(r["future_rows"] == 0 for r in audit["future"]), warn=True)
    out.add("revisions", True, f"{sum(r['revision_rows'] for r in audit['revisions'])} rows")
    out.add("availability by horizon", any(r["available"] for r in audit["horizons"]), warn=True)
    policy = config.get("known_at_policy", "require")
    if policy != "require":
        allowed = bool(config.get("publication_rules", {}).get("reconstruction_allowed"))
        out.add("documented publication rule", False, policy, warn=allowed)
    if given("timezone"):
        out.add("time zone", config["timezone"] in available_timezones(), str(config["timezone"]))
    for row in audit.get("timestamps", []):
        out.add(f"timestamps of {row['source_id']}", not row["unparseable"], f"{row['naive']} without a zone", warn=not row["unparseable"])
    if given("first_origin", "train_seconds"):
        begin = datetime.fromisoformat(config["first_origin"]) - timedelta(seconds=config.get("train_seconds", 0))
        out.add("sufficient history", any(r["first_event"] and r["first_event"] <= begin.replace(tzinfo=None) for r in cover.values()))
    if given("target_source_id"):
        own = cover.get(config["target_source_id"])
        empty = {r["source_id"]: r["missing"] for r in audit["missingness"]}
        labels = own["rows"] - empty.get(config["target_source_id"], 0) if own else 0
        out.add("sufficient labels", labels >= config.get("minimum_label_count", 1), str(labels))
    if given("candidates"):
        out.add("candidates available", bool(set(config["candidates"]) & set(CANDIDATES)))
    if given("output_directory"):
        out.add("output directory writable", writable(config["output_directory"]))
    return out


def acceptance(folder: str, report: Report | None = None, allow_fallback: bool = False) -> Report:
    """Whether a bundle loads, its hashes reproduce and its documents hold together.

    Parts that only an end-to-end run writes (contract, folds, provenance) are asked of the bundles that name a model.
    """
    from .responses import respond

    out = Report()
    try:
        docs = load_bundle(folder)
    except Refused as error:
        out.add("bundle", False, str(error))
        return out
    out.add("bundle", True)
    f, board, source = docs["forecast.json"], docs["scoreboard.json"], docs["provenance.json"]
    out.add("quantiles in order", f["quantiles"] == sorted(f["quantiles"]))
    out.add("probabilities sum to one", abs(sum(docs["histogram.json"]["probabilities"]) - 1) < 1e-9)
    out.add("hash reproduces", content_hash(f) == docs["run_manifest.json"]["artifacts"]["forecast.json"])
    out.add("scoreboard present", bool(board))
    if f.get("model_id"):
        out.add("contract complete", not any(placeholder(f.get(k)) for k in ("target", "unit", "sign_convention", "horizon_seconds")))
        out.add("point in time", bool(source.get("as_of_policy")) and bool(source.get("pit_ready") or source.get("raw_receipts")))
        out.add("units and time zones resolved", not any("unit" in str(e).lower() or "timezone" in str(e).lower() for e in source.get("errors", [])))
        folds = f.get("fold_summary", {})
        out.add("out-of-fold evidence", folds.get("folds", 0) > 0 and folds.get("oof_rows", 0) > 0)
        out.add("holdout untouched", folds.get("holdout_used") is False)
        out.add("champion evaluated", board.get("selected_model") in board.get("candidates", {}))
        unset = [k for k in ("source_ids", "dataset_manifest_id", "feature_manifest_id", "training_data_hash", "fit_cutoff") if not source.get(k)]
        out.add("provenance complete", not unset, ", ".join(unset))
    try:
        respond(f, docs["histogram.json"], board, source)
        out.add("answer valid", True)
    except Refused as error:
        out.add("answer valid", False, str(error))
    if source.get("abstained"):
        out.add("state", False, "abstained")
    elif source.get("fallback"):
        out.add("state", False, "fallback", warn=allow_fallback)
    else:
        out.add("state", "fallback" in source)
    if report is not None:
        out.add("readiness", report.ready)
    return out


class ForecastService:
    """Answers from bundles in memory."""

    def __init__(self, *folders: str, stale_after: timedelta = timedelta(hours=24)) -> None:
        self.bundles = {b["forecast.json"]["forecast_id"]: b for b in map(load_bundle, folders)}
        self.stale_after = stale_after

    def latest(self, now: datetime) -> dict:
        if not self.bundles:
            return {"state": "ABSTAIN", "forecast": None}
        best = max(self.bundles.values(), key=lambda b: datetime.fromisoformat(b["forecast.json"]["issue_time"]))
        return self._answer(best, now)

    def by_id(self, forecast_id: str, now: datetime) -> dict:
        if forecast_id not in self.bundles:
            return {"state": "ABSTAIN", "forecast": None}
        return self._answer(self.bundles[forecast_id], now)

    def document(self, forecast_id: str, name: str) -> dict:
        if forecast_id not in self.bundles:
            raise Refused(f"no forecast {forecast_id!r}")
        return self.bundles[forecast_id][f"{name}.json"]

    def health(self, now: datetime) -> dict:
        return {"status": "ok" if self.bundles else "empty", "forecasts": len(self.bundles), "state": self.latest(now)["state"]}

    def _answer(self, bundle: dict, now: datetime) -> dict:
        f, states = bundle["forecast.json"], {"NORMAL"}
        if now - datetime.fromisoformat(f["issue_time"]) > self.stale_after:
            states.add("DEGRADED")
        if bundle["provenance.json"].get("fallback"):
            states.add("FALLBACK")
        if bundle["provenance.json"].get("abstained"):
            states.add("ABSTAIN")
        return {"state": next(s for s in STATES if s in states), "forecast": f}


class ModelRegistry:
    """Candidates may be rejected or frozen; promotion is not this library's to give."""

    MOVES = {("CANDIDATE", "REJECTED"), ("CANDIDATE", "FROZEN")}

    def __init__(self) -> None:
        self.states: dict[str, str] = {}

    def register(self, model: str) -> None:
        if model in self.states:
            raise Refused(f"{model} is registered")
        self.states[model] = "CANDIDATE"

    def transition(self, model: str, state: str) -> None:
        if (self.states.get(model), state) not in self.MOVES:
            raise Refused(f"{self.states.get(model)} to {state}")
        self.states[model] = state


def topological_order(parents: dict[str, list[str]]) -> list[str]:
    """Parents first, ties by name; a cycle or an unknown parent is refused."""
    out: list[str] = []
    while len(out) < len(parents):
        free = sorted(n for n, ps in parents.items() if n not in out and all(p in out for p in ps))
        if not free:
            raise Refused("a cycle or an unknown parent")
        out.append(free[0])
    return out
