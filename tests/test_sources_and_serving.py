import io
import json
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from chronolake import cli
from chronolake.guards import Refused, refuse_leaking_columns
from chronolake.plans import serving
from chronolake.sources import raw_store, readers, sinks
from chronolake.streaming import asof

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_formats_and_mapping(spark, tmp_path):
    (tmp_path / "a.csv").write_text("s,v,x\na,1.5,\nb,,q\n")
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"s": "a", "v": "2"}]}))
    (tmp_path / "a.ndjson").write_text('{"s": "a"}\n{"s": "b"}\n')
    rows = readers.mapped(readers.load_rows(spark, str(tmp_path / "a.csv")), {"source_id": "s", "value": "v", "note": "x"}, {"country": "CH"}, {"note": "none"})
    assert sorted(map(tuple, rows.collect()), key=str) == [("a", "1.5", "none", "CH"), ("b", None, "q", "CH")]
    assert readers.load_rows(spark, str(tmp_path / "a.json")).first().v == "2"
    assert readers.load_rows(spark, str(tmp_path / "a.ndjson")).count() == 2
    with pytest.raises(Refused):
        readers.detect_format("a.xls")
    with pytest.raises(Refused):
        readers.mapped(rows, {"a": "source_id", "b": "source_id"}, {"a": "x"})
    with pytest.raises(Refused):
        refuse_leaking_columns(["generation_forecast", "actual_generation"])


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>PNX02</t></is></c></row><row r="2"/><row r="3"><c r="A3"><v>45292</v></c><c r="C3"><v>7.5</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>date</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    cells = readers.workbooks(spark, str(tmp_path / "b.xlsx"))
    assert [r.cells for r in cells.orderBy("row").collect()] == [["date", "", "PNX02"], [], ["45292", "", "7.5"]]
    row = readers.price_series(cells, "price").first()
    assert (row.ts, row.value, row.known_at) == (datetime(2024, 1, 1, 0, 0), 7.5, datetime(2023, 12, 31, 11, 0))


def test_raw_store_keeps_what_it_received(spark, tmp_path):
    store = raw_store.RawStore(str(tmp_path / "r"))
    body = json.dumps({"unit": "MW", "value": 1.0}).encode()
    a, b = store.put(body, "load", NOW), store.retrieve(lambda: body, "load", lambda: NOW + timedelta(hours=1))
    assert a.sha256 == b.sha256 and store.read(a.sha256) == body
    assert [r.receipt_id for r in store.manifests(spark).collect()] == [a.receipt_id, b.receipt_id]
    rows = raw_store.ingest(spark, store, "unit string, value double", {"load": ["MW"]}).collect()
    assert len(rows) == 1 and rows[0].raw_sha256 == a.sha256
    with pytest.raises(Refused):
        raw_store.ingest(spark, store, "unit string, value double", {"load": ["kW"]})
    with pytest.raises(Refused):
        raw_store.publish(str(tmp_path / "r/raw" / a.sha256), b"other")


def bundle(folder):
    f = serving.forecast_document("f1", "CH", NOW, 3 * 86400, [-5, 0, 5, 9] * 75)
    sinks.write_bundle(folder, {"forecast.json": f, "histogram.json": serving.histogram_document(f), "scoreboard.json": {"mae": 1.0}, "provenance.json": {"fallback": False}})
    return f


def test_bundle_service_and_acceptance(tmp_path, capsys):
    f = bundle(str(tmp_path / "b"))
    assert f["target_time"] == (NOW + timedelta(days=3)).isoformat() and not f["quantile_repair_applied"]
    service = serving.ForecastService(str(tmp_path / "b"))
    assert service.latest(NOW)["state"] == "NORMAL" and service.latest(NOW + timedelta(days=2))["state"] == "DEGRADED"
    assert service.by_id("none", NOW)["state"] == "ABSTAIN" and service.document("f1", "scoreboard") == {"mae": 1.0}
    assert serving.acceptance(str(tmp_path / "b")).ready and cli.main(["acceptance", str(tmp_path / "b")]) == 0
    path = tmp_path / "b" / "scoreboard.json"
    path.chmod(0o644)
    for broken in ('{"mae": 2.0}', '{"mae": NaN}', "{"):
        path.write_text(broken)
        assert not serving.acceptance(str(tmp_path / "b")).ready
    capsys.readouterr()


def test_registry_and_order():
    r = serving.ModelRegistry()
    r.register("m")
    r.transition("m", "FROZEN")
    for bad in (lambda: r.register("m"), lambda: r.transition("m", "REJECTED"), lambda: r.transition("x", "FROZEN")):
        with pytest.raises(Refused):
            bad()
    assert serving.topological_order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(Refused):
        serving.topological_order({"a": ["b"], "b": ["a"]})


def test_prediction_table_and_cooldown(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1), [1] * 300)], "timestamp timestamp_ntz, CH array<int>")
    assert sinks.write_predictions(df, "predictions_t", ["CH"], rows=1, mode="overwrite").count() == 1
    sinks.append_result(spark, "results_t", "g", 0.5, "id", NOW)
    last = spark.table("results_t").first()["timestamp"]
    assert not sinks.cooldown_over(spark, "results_t", "g", last, 60) and sinks.cooldown_over(spark, "results_t", "h", last, 60)
    spark.sql("drop table predictions_t")
    spark.sql("drop table results_t")


def test_stream_drops_late_old_revisions(spark, tmp_path):
    schema = "source_id string, source_record_id string, revision_sequence int, known_at timestamp, event_time timestamp, value double"
    spark.createDataFrame([("s", "r", q, NOW + timedelta(hours=q), NOW + timedelta(minutes=10 * q), float(q)) for q in (1, 0, 2)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = asof.newest_revisions(stream).writeStream.outputMode("complete").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    assert [r.value for r in spark.table("newest").collect()] == [2.0]
    for name, out in (("means", asof.hourly_means(stream)), ("once", asof.without_repeats(stream))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("means").columns == ["source_id", "hour", "value", "n"] and spark.table("once").count() == 3


def test_catalogue_names_match():
    from chronolake import catalogue

    assert set(catalogue.oracle_sql()) < set(catalogue.queries()) and len(catalogue.queries()) >= 60
