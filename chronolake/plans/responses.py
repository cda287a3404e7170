"""The answer of the forecast service as a document, its validator, and the same over HTTP."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..guards import Refused
from ..sources.sinks import canonical
from .serving import STATES, ForecastService, quantile

#: Parts of an answer, and the quantiles that it names.
SCHEMA = "forecast-answer.v1"
PARTS = ("forecast", "probability", "visualization", "model", "evidence", "state")
LEVELS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def state_of(*, abstained: bool = False, fallback: bool = False, degraded: bool = False) -> str:
    """The strongest state that applies."""
    held = {"ABSTAIN": abstained, "FALLBACK": fallback, "DEGRADED": degraded, "NORMAL": True}
    return next(s for s in STATES if held[s])


def respond(forecast: dict, histogram: dict, scoreboard: dict, provenance: dict, *, stale: bool = False) -> dict:
    """An answer from the documents of a bundle."""
    s = forecast["samples"]
    marks = {name: quantile(s, p) for name, p in LEVELS.items()}
    warnings = list(forecast.get("warnings", [])) + (["the forecast is stale"] if stale else [])
    model = forecast.get("model_id")
    export = forecast["export_probability"]
    out = {
        "schema_version": SCHEMA,
        "forecast": {k: forecast.get(k) for k in ("forecast_id", "issue_time", "target_time", "horizon_seconds", "target", "unit", "sign_convention")},
        "probability": {**marks, "probability_export": export, "probability_import": 1 - export},
        "visualization": {"histogram": histogram, "median": marks["p50"], "central_50_interval": [marks["p25"], marks["p75"]], "central_90_interval": [quantile(s, 0.05), quantile(s, 0.95)]},
        "model": {"model_id": model, "metrics": scoreboard.get("candidates", {}).get(model), "fit_cutoff": forecast.get("fit_cutoff")},
        "evidence": {"sources": provenance.get("source_ids", []), "dataset": provenance.get("dataset_manifest_id"), "features": provenance.get("feature_manifest_id"), "warnings": warnings},
        "state": state_of(abstained=bool(provenance.get("abstained")), fallback=bool(provenance.get("fallback")), degraded=bool(warnings)),
    }
    return validate(out)


def validate(answer: dict) -> dict:
    """The answer, or a refusal that names what is wrong with it."""
    if answer.get("schema_version") != SCHEMA:
        raise Refused("unknown schema")
    missing = [p for p in PARTS if p not in answer]
    if missing:
        raise Refused(f"missing parts: {', '.join(missing)}")
    marks = [answer["probability"].get(k) for k in LEVELS]
    if any(isinstance(m, bool) or not isinstance(m, (int, float)) or not math.isfinite(m) for m in marks) or marks != sorted(marks):
        raise Refused("quantiles must be finite and in order")
    both = [answer["probability"].get(f"probability_{k}") for k in ("import", "export")]
    if (both[0] is None) != (both[1] is None):
        raise Refused("import and export go together")
    if both[0] is not None and (not all(0 <= p <= 1 for p in both) or abs(sum(both) - 1) > 1e-12):
        raise Refused("import and export are no probabilities of one event")
    if abs(sum(answer["visualization"]["histogram"]["probabilities"]) - 1) > 1e-9:
        raise Refused("the histogram's shares do not sum to one")
    if answer["state"] not in STATES:
        raise Refused("unknown state")
    canonical(answer)  # refuses numbers that JSON has no word for
    return answer


def route(service: ForecastService, path: str, now: datetime) -> tuple[int, dict]:
    """Status and document of a GET request: health, forecast, scoreboard, histogram and provenance."""
    parts = [p for p in path.partition("?")[0].split("/") if p]

    def latest() -> str:
        found = service.latest(now)["forecast"]
        if found is None:
            raise Refused("no forecast")
        return found["forecast_id"]

    try:
        if parts == ["health"]:
            return 200, service.health(now)
        if len(parts) == 2 and parts[0] == "forecast":
            known = latest() if parts[1] == "latest" else parts[1]
            docs = {n: service.document(known, n) for n in ("forecast", "histogram", "scoreboard", "provenance")}
            stale = now - datetime.fromisoformat(docs["forecast"]["issue_time"]) > service.stale_after
            return 200, respond(*docs.values(), stale=stale)
        if parts == ["scoreboard"]:
            return 200, service.document(latest(), "scoreboard")
        if parts == ["histogram", "latest"]:
            return 200, service.document(latest(), "histogram")
        if len(parts) == 2 and parts[0] == "provenance":
            return 200, service.document(parts[1], "provenance")
    except Refused as error:
        return 404, {"error": str(error)}
    return 404, {"error": f"no route {path}"}


def server(service: ForecastService, port: int = 0, host: str = "127.0.0.1", clock=lambda: datetime.now(timezone.utc)) -> ThreadingHTTPServer:
    """A server that has not started: ``serve_forever`` does."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, document = route(service, self.path, clock())
            body = json.dumps(document, sort_keys=True, allow_nan=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
