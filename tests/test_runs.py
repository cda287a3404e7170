"""End-to-end runs, answers, specialists and registries."""

import json
import threading
import urllib.request
from datetime import datetime, timedelta, timezone

import pytest

from chronolake.guards import Refused
from chronolake.plans import responses, runs, serving, specialists
from chronolake.sources import sinks

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)


def test_synthetic_run_end_to_end(spark, tmp_path):
    stages = []
    out = runs.run_synthetic(spark, str(tmp_path / "run"))
    assert set(out["champions"]) == {"net_position", "load"} and set(out["seconds"]) == {"readiness", "backtest", "artifacts"}
    report = serving.acceptance(str(tmp_path / "run"))
    assert report.ready and len(report.checks) >= 14, report.checks
    service = serving.ForecastService(str(tmp_path / "run"))
    status, answer = responses.route(service, "/forecast/latest", datetime(2024, 1, 31, tzinfo=timezone.utc))
    assert status == 200 and answer["state"] == "NORMAL" and answer["model"]["metrics"]["mae_mean"] > 0
    best = min((b for b in out["scoreboard"] if b["target_name"] == "load"), key=lambda b: (b["mae_mean"], b["model_id"]))
    assert out["champions"]["load"] == best["model_id"]
    base = spark.createDataFrame([("load", "ridge", 2.0)], "target_name string, model_id string, mae_mean double")
    assert runs.family_gains(base, base.selectExpr("target_name", "model_id", "mae_mean - 0.5 as mae_mean"), "prices").first().mae_gain == 0.5
    assert not stages


def bundle(folder, **provenance):
    f = serving.forecast_document("f1", "CH", NOW, 3600, [-5, 0, 5, 9] * 75)
    sinks.write_bundle(folder, {"forecast.json": f, "histogram.json": serving.histogram_document(f), "scoreboard.json": {"mae": 1.0}, "provenance.json": {"fallback": False} | provenance})
    return f


def test_answers_and_routes(tmp_path):
    bundle(str(tmp_path / "a"))
    service = serving.ForecastService(str(tmp_path / "a"))
    good = responses.route(service, "/forecast/f1", NOW)[1]
    for change in ({"schema_version": "x"}, {"state": "GREAT"}, {"probability": good["probability"] | {"p10": 99.0}}, {"probability": good["probability"] | {"p50": float("nan")}}, {"probability": good["probability"] | {"probability_import": None}}, {"probability": good["probability"] | {"probability_import": 0.9}}):
        with pytest.raises(Refused):
            responses.validate(good | change)
    with pytest.raises(Refused, match="missing"):
        responses.validate({k: v for k, v in good.items() if k != "model"})
    assert responses.route(service, "/forecast/latest", NOW + timedelta(days=3))[1]["state"] == "DEGRADED"
    assert [responses.state_of(abstained=True, fallback=True), responses.state_of(fallback=True, degraded=True), responses.state_of()] == ["ABSTAIN", "FALLBACK", "NORMAL"]
    server = responses.server(service, clock=lambda: NOW)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=10))
    assert get("/health")["status"] == "ok" and get("/scoreboard") == {"mae": 1.0} and get("/histogram/latest")["forecast_id"] == "f1" and get("/provenance/f1") == {"fallback": False} and get("/forecast/f1") == good
    with pytest.raises(urllib.error.HTTPError):
        get("/forecast/none")
    server.shutdown()


def test_acceptance_of_states(tmp_path):
    for k, (provenance, allow, ready) in enumerate((({"fallback": True}, False, False), ({"fallback": True}, True, True), ({"abstained": True}, True, False))):
        bundle(str(tmp_path / str(k)), **provenance)
        assert serving.acceptance(str(tmp_path / str(k)), allow_fallback=allow).ready is ready


def test_readiness_asks_what_the_configuration_names(tmp_path):
    audit = {
        "coverage": [{"source_id": "s", "rows": 9, "eligible": 9, "first_event": datetime(2024, 1, 1)}], "units": [{"consistent": True}], "cadence": [{"median_seconds": 3600.0}], "duplicates": [{"duplicate_rows": 0}],
        "stale": [{"stale": False}], "missingness": [{"source_id": "s", "fraction": 0.1, "missing": 1}], "future": [{"future_rows": 0}], "revisions": [{"revision_rows": 2}], "horizons": [{"available": True}],
    }
    assert serving.readiness(audit, {}, ["s"]).ready and not serving.readiness(audit, {}, ["s", "t"]).ready
    (tmp_path / "file").write_text("")
    full = {
        "target": {k: "set" for k in serving.CONTRACT}, "columns": {"value": "v"}, "timezone": "Europe/Zurich", "first_origin": "2024-01-05T00:00:00", "train_seconds": 86400, "target_source_id": "s",
        "candidates": ["ridge"], "output_directory": str(tmp_path / "new" / "folder"), "known_at_policy": "publication_plus_lag", "publication_rules": {"reconstruction_allowed": True},
    }
    report = serving.readiness(audit, full, ["s"])
    assert report.ready and len(report.checks) >= 20 and report.checks["documented publication rule"][0] == "WARNING"
    for change in ({"timezone": "Mars/Base"}, {"first_origin": "2024-01-01T00:00:00"}, {"minimum_label_count": 9}, {"candidates": ["oracle"]}, {"publication_rules": {}}, {"target": {"unit": "<unit>"}}, {"output_directory": str(tmp_path / "file" / "x")}):
        assert not serving.readiness(audit, full | change, ["s"]).ready, change


def brief(**change):
    return specialists.Brief(**{"specialist": "w", "kind": "evidence", "family": "weather", "issue_time": NOW, "known_at": NOW - HOUR, "horizons": (HOUR,), "values": {"wind": 3.0}} | change)


def test_specialists():
    registry = specialists.Registry([specialists.Specialist("w", "weather", ("evidence", "forecast")), specialists.Specialist("off", "weather", enabled=False), specialists.Specialist("n", "news")])
    context = specialists.Context(NOW, HOUR, NOW + HOUR, NOW)
    assert specialists.run(registry, "w", lambda c: brief(), context).values == {"wind": 3.0}
    assert [s.id for s in registry.list(family="weather")] == ["off", "w"]
    assert [b.specialist for b in specialists.run_many(registry, {"w": lambda c: brief(), "n": lambda c: brief(specialist="n", family="news")}, context)] == ["n", "w"]
    for name, act in (("off", lambda c: brief(specialist="off")), ("x", lambda c: brief()), ("w", lambda c: {"wind": 3}), ("w", lambda c: 1 / 0), ("w", 5), ("w", lambda c: brief(specialist="n")), ("w", lambda c: brief(family="news")), ("w", lambda c: brief(issue_time=NOW + HOUR)), ("w", lambda c: brief(horizons=(2 * HOUR,))), ("n", lambda c: brief(specialist="n", family="news", kind="forecast", target_time=NOW + HOUR)), ("w", lambda c: brief(kind="forecast", target_time=NOW))):
        with pytest.raises(Refused):
            specialists.run(registry, name, act, context)
    for change in ({"uncertainty": {"trust_score": 1.0}}, {"uncertainty": {"Calibrated": True}}, {"flags": ("calibration-claim",)}, {"values": {"x": float("inf")}}, {"known_at": NOW + HOUR}, {"horizons": ()}, {"kind": "forecast"}, {"issue_time": datetime(2026, 1, 1)}, {"specialist": " "}):
        with pytest.raises(Refused):
            brief(**change)
    assert brief(uncertainty={"calibrated": True}, oof_folds=("1",)).oof_folds == ("1",)
    with pytest.raises(Refused):
        specialists.run_many(registry, {}, context)


def test_claims_need_evidence():
    claim = {"baseline": "b", "component": "w", "kind": "specialist", "metric": "mae", "delta": -1.0, "folds": ("1", "2"), "horizon": HOUR}
    assert specialists.Contribution(**claim, decision="KEEP", evidence=("better in both",)).decision == "KEEP"
    for change in ({"decision": "KEEP"}, {"scope": "train"}, {"folds": ("1", "1")}, {"folds": ()}, {"delta": float("nan")}, {"kind": "x"}, {"uncertainty": -1.0}, {"horizon": timedelta(0)}, {"metric": ""}):
        with pytest.raises(Refused):
            specialists.Contribution(**claim | change)


def test_sources_and_binding():
    config = {"id": "load", "domain": "load", "country": "CH", "units": ["MW"], "timezone": "Europe/Zurich", "cadence_seconds": 900}
    own = specialists.Source.from_config(config)
    sources = specialists.Registry([own])
    assert own.cadence == timedelta(minutes=15) and specialists.bind_targets(["CH"], sources, {"CH": "load"}) == {"CH": own}
    for change in ({"timezone": "Mars/Base"}, {"units": []}, {"is_forecast": True}, {"cadence_seconds": 0}, {"other": 1}, {"country": ""}):
        with pytest.raises(Refused):
            specialists.Source.from_config(config | change)
    assert specialists.Source.from_config(config | {"is_forecast": True, "horizon_seconds": 3600, "publication_rule": "noon"}).horizon == HOUR
    for act in (lambda: sources.register(own), lambda: sources.get("x"), lambda: specialists.bind_targets(["CH", "DE"], sources, {"CH": "load"})):
        with pytest.raises(Refused):
            act()
