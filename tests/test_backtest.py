"""Out-of-fold evidence, samplers, exact ranks and blocks against plain versions."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.functions import scalars
from chronolake.guards import Refused
from chronolake.operators import feature_audit, models, oof, pit, quality, scoring, series, splits, uncertainty
from chronolake.sources import readers

T = datetime(2024, 1, 1)
H = lambda n: timedelta(hours=n)
PLAN = splits.Plan(T + H(48), T + H(144), H(48), H(24), H(0), H(24))
VERSIONS = {"persistence": "1", "hod_mean": "1", "seasonal_24h": "1"}
HASH = "a" * 64


def samples(spark, targets=("x", "y"), gap=None):
    rows = [(t, f"r{k:03}", T + H(k), T + H(k + 1), T + H(k), T + H(k + 1), k % 24, float(k % 24 + (t == "y") * 10), [float(k % 24)]) for t in targets for k in range(150) if k != gap]
    return spark.createDataFrame(rows, "target_name string, row_id string, issue_time timestamp_ntz, target_time timestamp_ntz, feature_known_at timestamp_ntz, label_known_at timestamp_ntz, hod int, target double, features array<double>")


def test_evidence_is_compared_on_equal_cases(spark):
    a = splits.assign(samples(spark, gap=60), PLAN)
    every = oof.point_candidates(a, 24, "hod", "target_name")
    kept = models.eligible(every, "target_name")
    assert {r.model_id for r in kept.select("model_id").distinct().collect()} == {"persistence", "hod_mean"}
    assert {r["rows"] for r in models.scoreboard(kept, "target_name", "model_id").collect()} == {kept.select("row_id", "fold_id").distinct().count()}
    got = {(r.target_name, r.model_id): (r.missing, r.extra) for r in oof.coverage(every, a, "target_name").collect()}
    assert got["x", "persistence"] == (0, 0) and got["x", "seasonal_24h"][0] > 0
    extra = every.withColumn("row_id", F.when(F.col("row_id") == "r050", "zzz").otherwise(F.col("row_id")))
    assert {r.extra for r in oof.coverage(extra, a, "target_name").collect()} == {1}


def test_fitted_models_predict_every_case(spark):
    a = splits.assign(samples(spark), PLAN)
    lost = a.where(~((F.col("fold_id") == 0) & (F.col("partition") == "train") & (F.col("target_name") == "x")))
    out = models.fitted(lost, "ridge", models.Ridge, "target_name")
    assert out.count() == lost.where("partition = 'validation'").count()
    assert {r.fold_id for r in out.where("prediction is null").collect()} == {0} and out.where("prediction is null and target_name = 'y'").isEmpty()


def test_execution_and_revalidation(spark):
    a = splits.assign(samples(spark), PLAN)
    records = oof.execute(a, oof.point_candidates(a, 24, "hod", "target_name"), PLAN, VERSIONS, HASH, "target_name")
    oof.require_valid(oof.revalidate(records, a, PLAN, VERSIONS, HASH, "target_name"))
    with pytest.raises(Refused, match="truth differs"):
        oof.require_valid(oof.revalidate(records.withColumn("truth", F.col("truth") + 1), a, PLAN, VERSIONS, HASH, "target_name"))
    with pytest.raises(Refused, match="training rows differ"):
        changed = a.withColumn("target", F.when(F.col("row_id") == "r020", -1.0).otherwise(F.col("target")))
        oof.require_valid(oof.revalidate(records, changed, PLAN, VERSIONS, HASH, "target_name"))
    with pytest.raises(Refused, match="no records"):
        oof.require_valid(oof.revalidate(records.limit(0), a, PLAN, VERSIONS, HASH, "target_name"))
    with pytest.raises(Refused, match="fold without"):
        oof.execute(a.where("fold_id <> 1 or partition <> 'train'"), records.drop("version", "training_cutoff", "feature_hash", "training_hash"), PLAN, VERSIONS, HASH, "target_name")
    hidden = oof.hide_truth(a).first()
    assert hidden.target is None and hidden.label_known_at == hidden.target_time


def test_hash_of_rows_ignores_order_and_counts_repeats(spark):
    rows = [(k % 2, k, f"v{k}") for k in range(20)]
    df = spark.createDataFrame(rows, "g int, k int, v string")
    one = lambda x: {r.g: r.hash for r in oof.set_hash(x, ["k", "v"], "g").collect()}
    assert one(df) == one(df.orderBy(F.desc("k")).repartition(7)) != one(df.unionByName(df.limit(1)))


def test_joint_rows(spark):
    a = splits.assign(samples(spark), PLAN)
    rows = oof.selected(models.eligible(oof.point_candidates(a, 24, "hod", "target_name"), "target_name"), spark.createDataFrame([("x", "hod_mean"), ("y", "persistence")], "target_name string, model_id string"), "target_name")
    out = oof.require_handoff(oof.joint(rows, "target_name", ["x", "y"]), ["x", "y"])
    assert out.columns == oof.handoff_columns(["x", "y"]) and out.count() == a.where("partition = 'validation' and target_name = 'x'").count()
    r = {s.target: s for s in oof.residual_summary(out, ["x", "y"]).collect()}
    assert abs(r["x"].mae) < 1e-9 and r["y"].rmse >= r["y"].mae > 0 and r["y"].bias == -r["y"].residual_mean
    for broken, why in ((rows.where("target_name = 'x'"), "missing"), (rows.unionByName(rows.limit(1)), "predicted twice"), (rows.withColumn("prediction", F.lit(float("nan"))), "null"), (rows.withColumn("issue_time", F.col("target_time")), "chronology"), (rows.withColumn("fold_id", F.when(F.col("row_id") == "r049", 7).otherwise(0)).withColumn("target_time", F.lit(T + H(500)).cast("timestamp_ntz")), "two folds")):
        with pytest.raises(Refused, match=why):
            oof.joint(broken, "target_name", ["x", "y"])
    with pytest.raises(Refused):
        oof.require_handoff(out.select(*reversed(out.columns)), ["x", "y"])


def test_handoff_file(spark, tmp_path):
    head = "timestamp,fold_id,horizon,issue_time,x_actual,x_pred,x_residual\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-02T00:00:00,0,24,2024-01-01T00:00:00,1.5,1.0,0.5\n")
    (tmp_path / "b.csv").write_text(head + "2024-01-02T00:00:00,0,24,2024-01-03T00:00:00,1.5,1.0,0.5\n")
    assert oof.read_handoff(spark, str(tmp_path / "a.csv"), ["x"]).first().x_residual == 0.5
    with pytest.raises(Refused):
        oof.read_handoff(spark, str(tmp_path / "b.csv"), ["x"])


def panel(spark, weeks=4, n=24, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(w, T + H(24 * w + k), k + 1, *map(float, rng.normal(1, 2, 2))) for w in range(weeks) for k in range(n)]
    return spark.createDataFrame(rows, "week int, timestamp timestamp_ntz, horizon int, x double, y double"), rows


def test_samplers_walk_forward(spark):
    df, rows = panel(spark)
    methods = ["independent_gaussian", "empirical_bootstrap", "student_t"]
    out = {(r.method, r.week): r for r in uncertainty.evaluate_samplers(df, ["x", "y"], methods, seed=5, samples=50).collect()}
    assert set(out) == {(m, w) for m in methods for w in (1, 2, 3)}
    for m, w in out:
        past, own = np.array([r[3:] for r in rows if r[0] < w]), np.array([r[3:] for r in rows if r[0] == w])
        hits, widths, errors = [], [], []
        for i, truth in enumerate(own):
            z = uncertainty.noise(np.random.default_rng([5, methods.index(m), w, i]), 50, m, past)
            lo, mid, hi = np.quantile(z, [0.05, 0.5, 0.95], axis=0)
            hits.append((lo <= truth) & (truth <= hi))
            widths.append(hi - lo)
            errors.append(np.abs(mid - truth))
        capture, sharp, mae = np.mean(hits), np.mean(widths), np.mean(errors)
        assert abs(out[m, w].capture - capture) < 1e-9 and abs(out[m, w].score - (mae + 0.5 * sharp + 10 * max(0, 0.9 - capture))) < 1e-9
    with_horizon = uncertainty.evaluate_samplers(df, ["x", "y"], ["horizon_covariance"], seed=5, samples=50).collect()
    assert {r.week for r in with_horizon} == {2, 3}
    with pytest.raises(Refused):
        uncertainty.evaluate_samplers(df.where("week = 0"), ["x", "y"], methods, seed=5)


def test_calibration_is_the_least_scale_that_covers(spark):
    df, _ = panel(spark)
    fit, own = df.where("week < 2"), df.where("week >= 2").withColumns({"x": F.col("x") * 1.5 - 0.5, "y": F.col("y") * 1.5 - 0.5})
    got = uncertainty.calibrate(fit, own, ["x", "y"], F.lit(0), key="timestamp", seed=3, samples=200).first().scale
    curve = {r.scale: r.capture for r in _capture(fit, own, [got * 0.97, got * 1.0001])}
    assert curve[got * 0.97] < 0.5 <= curve[got * 1.0001] and 0.1 <= got <= 5
    with pytest.raises(Refused, match="overlap"):
        uncertainty.calibrate(df, df, ["x", "y"], F.lit(0), key="timestamp", seed=3)


def _capture(fit, own, scales):
    fits = uncertainty.covariance(fit.withColumn("bucket", F.lit(0)), ["x", "y"], "bucket").drop("n")
    rows = uncertainty._noise_quantiles(own, fits, ["x", "y"], F.lit(0), "timestamp", 3, 200, 0.25)
    each = rows.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    return each.groupBy("scale").agg(F.avg(((F.col("e") >= F.sqrt("scale") * F.col("low")) & (F.col("e") <= F.sqrt("scale") * F.col("high"))).cast("double")).alias("capture")).collect()


def test_curve_pool_and_choice(spark):
    df, rows = panel(spark)
    curve = sorted(uncertainty.capture_curve(df, ["x", "y"], [0.25, 1.0, 4.0], key="timestamp", seed=1, samples=50).collect())
    assert [r.scale for r in curve] == [0.25, 1.0, 4.0] and curve[0].capture < curve[1].capture < curve[2].capture and abs(curve[2].sharpness - 4 * curve[0].sharpness) < 1e-9
    drawn = uncertainty.pool_samples(df.select("timestamp", F.lit(100.0).alias("x"), F.lit(0.0).alias("y")), df, ["x", "y"], key="timestamp", seed=1)
    allowed = {round(100 + r[3]) for r in rows}
    assert all(set(r.x) <= allowed and len(r.x) == 300 for r in drawn.collect())
    table = scoring.submission_table(drawn, ["y", "x"], "timestamp", rows_expected=96)
    assert table.columns == ["timestamp", "target_0", "target_1"] and sorted(table.first().target_1) == sorted(drawn.where(F.col("timestamp") == F.lit(str(table.first().timestamp)).cast("timestamp_ntz")).first().x)
    with pytest.raises(Refused):
        scoring.submission_table(drawn, ["x", "z"], "timestamp")
    with pytest.raises(Refused):
        scoring.submission_table(drawn, ["x", "y"], "timestamp", rows_expected=168)
    weekly = spark.createDataFrame([(w, m, s) for w, a, b in ((0, 1.0, 2.0), (1, 1.0, 2.0), (2, 9.0, 2.0), (3, 1.0, 1.0)) for m, s in (("a", a), ("b", b))], "week int, method string, score double")
    assert [r.method for r in sorted(uncertainty.method_choice(weekly, "b").collect())] == ["b", "b", "a", "b"]
    with pytest.raises(Refused):
        uncertainty.residual_panel(spark.createDataFrame([(1, "x", 1.0)], "k int, target string, residual double"), ["x", "y"], "k", strict=True)
    assert uncertainty.draw(1, 4, [[1.0]], [0.0], freedom=2.5) != uncertainty.draw(1, 4, [[1000.0]], [0.0], freedom=2.5)
    assert np.allclose(uncertainty.diagonal(np.array([[2.0, 1.0], [1.0, 3.0]])), [[2, 0], [0, 3]])


def test_records_of_outputs(spark):
    rows = [(T + H(k), t, [k, k + 1]) for k in range(3) for t in "xy"]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, target string, samples array<int>")
    assert scoring.records_of(df, ["x", "y"]).count() == 3
    for broken in (df.limit(5), df.unionByName(df.limit(1)), df.withColumn("target", F.lit("x"))):
        with pytest.raises(Refused):
            scoring.records_of(broken, ["x", "y"])


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_exact_quantiles_and_ranks(spark, monkeypatch, bins):
    rng = random.Random(2)
    rows = [(k % 3, float(rng.choice([0, 1, 1, 5, 1e6 * rng.random()]))) for k in range(400)] + [(9, 4.0), (9, None), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(quality.cumulative, "__defaults__", (bins,))
    got = {r.g: r.q for r in quality.quantiles(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0], "g").collect()}
    for g in (0, 1, 2, 9):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.1, 0.5, 0.77, 1.0]))
    assert 8 not in got
    ranked = feature_audit.average_ranks(df.where("g = 0"), "v", "r", "g").collect()
    values = sorted(r.v for r in ranked)
    assert all(r.r == values.index(r.v) + 1 + (values.count(r.v) - 1) / 2 for r in ranked)


def test_windows_in_blocks(spark):
    rng = random.Random(3)
    rows = [(k % 2, T + timedelta(minutes=rng.randrange(60 * 24 * 9)), None if rng.random() < 0.05 else float(k)) for k in range(300)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g int, t timestamp_ntz, value double, id int")
    for hours in (5, 40):
        for r in series.elapsed_window(df, ["g"], "t", hours).collect():
            inside = [v for g, t, v in rows if g == r.g and r.t - H(hours) < t <= r.t]
            assert r.w_max == (None if None in inside else max(inside)) and (None in inside or abs(r.w_mean - np.mean(inside)) < 1e-9)
    issues = spark.createDataFrame([(g, T + H(h)) for g in (0, 1) for h in range(-5, 240, 7)], "g int, issue timestamp_ntz")
    got = series.latest_before(df.withColumnRenamed("t", "known_at"), issues, ["g"]).collect()
    assert len(got) == issues.count()
    for r in got:
        before = [(t, v is not None, v) for g, t, v in rows if g == r.g and t <= r.issue]
        assert (r.event_at, r.value) == ((max(before)[0], max(before)[2]) if before else (None, None))


def test_scaler_keeps_to_its_training_rows(spark):
    rows = [(k, "s", T + H(k), T + H(k), float(k), ["raw"], "train" if k < 5 else None) for k in range(8)]
    df = spark.createDataFrame(rows, "event_id int, source_id string, event_time timestamp_ntz, known_at timestamp_ntz, value double, sources array<string>, partition string")
    cutoff = F.lit(str(T + H(4))).cast("timestamp_ntz")
    fit = series.fit_scale(df.where("partition = 'train'"), "value", cutoff, "source_id")
    out = {r.event_id: r for r in series.apply_scale(df, fit, "value", "source_id").collect()}
    assert abs(out[4].value - 2 / 2**0.5) < 1e-9 and out[0].known_at == T + H(4) and out[7].known_at == T + H(7) and out[7].sources == ["raw", "s:fit"]
    for broken in (df, df.where("partition = 'train'").unionByName(df.limit(1))):
        with pytest.raises(Refused):
            series.fit_scale(broken, "value", cutoff, "source_id")
    with pytest.raises(Refused):
        series.refuse_repeated_times(df.unionByName(df.limit(1)), "event_time", "source_id")


def test_sources_as_of_many(spark):
    row = lambda s, k, q, h: (s, k, q, T + H(h), float(q))
    schema = "source_id string, source_record_id string, revision_sequence int, known_at timestamp_ntz, value double"
    a, b = spark.createDataFrame([row("a", "1", 0, 0), row("a", "1", 1, 30), row("a", "1", 2, 90)], schema), spark.createDataFrame([row("b", "1", 0, 5)], schema)
    at = lambda h: F.lit(str(T + H(h))).cast("timestamp_ntz")
    assert sorted((r.source_id, r.revision_sequence) for r in pit.resolve_sources([a, b], at(40), "value").collect()) == [("a", 1), ("b", 0)]
    with pytest.raises(Refused):
        pit.resolve_sources([a, a], at(40), "value")
    issues = spark.createDataFrame([(T + H(h),) for h in range(-30, 200, 3)], "issue timestamp_ntz")
    got = {(r.issue, r.source_id): r.revision_sequence for r in pit.as_of_many(a.unionByName(b), issues).collect()}
    for h in range(-30, 200, 3):
        known = [q for q, k in ((0, 0), (1, 30), (2, 90)) if k <= h]
        assert got.get((T + H(h), "a")) == (max(known) if known else None) and got.get((T + H(h), "b")) == (0 if h >= 5 else None)


def test_fold_helpers(spark):
    hours = spark.createDataFrame([(T + H(k),) for k in range(100)], "hour timestamp_ntz")
    at = lambda h: F.lit(str(T + H(h))).cast("timestamp_ntz")
    warm = splits.warm_start_folds(hours, at(60), 2, 20, 10).where("part = 'forecast'").agg(F.min("hour").alias("a"), F.max("hour").alias("b")).first()
    assert (warm.a, warm.b) == (T + H(40), T + H(59))
    with pytest.raises(Refused):
        splits.warm_start_folds(hours, at(5), 2, 20, 10)
    with pytest.raises(Refused, match="before: 60 hours, 65 needed"):
        splits.require_history(hours, at(60), 2, train_hours=20, week=10, longest_lag=45)
    splits.require_history(hours, at(60), 2, train_hours=20, week=10, longest_lag=40)
    weeks = splits.origin_weeks(spark, T + H(20), 2, 10).collect()
    assert len(weeks) == 20 and min(r.issue_time for r in weeks) == T and max(r.target_time for r in weeks) == T + H(20)
    parts = splits.nested_weeks(spark.range(5).withColumnRenamed("id", "week"), 2, 1)
    assert [r.part for r in parts.orderBy("week").collect()] == ["fit", "fit", "calibrate", "demo", "demo"]
    with pytest.raises(Refused):
        splits.precheck(samples(spark).unionByName(samples(spark)))


def test_readers_of_evidence(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes(b"\xef\xbb\xbfissue_time_utc,total_unavailable_mw_h0\n2024-01-01T00:00:00Z,5\n2024-01-01T00:00:00Z,\"1,007\"\n2024-01-02T00:00:00Z,nan\n")
    rows = readers.publication_rows(spark, str(tmp_path / "n.csv"))
    assert rows.columns[0] == "issue_time_utc" and [r.value for r in readers.daily_unavailability(rows).collect()] == [1007.0]
    files = {"n": str(tmp_path / "n.csv"), "gone": str(tmp_path / "x.csv")}
    out, inventory = readers.family(spark, files, {k: lambda s, p: readers.daily_unavailability(readers.publication_rows(s, p)) for k in files})
    assert out.count() == 1 and {i["feature"]: i["status"] for i in inventory} == {"n": "selected", "gone": "rejected"}
    assert readers.resolve_root("given", "NO_SUCH_VARIABLE_HERE") == "given" and readers.resolve_root(None, "NO_SUCH_VARIABLE_HERE", "/nowhere", str(tmp_path)) == str(tmp_path)
    (tmp_path / "s.json").write_text(json.dumps({"manifest": {"schema": {"columns": [{"name": "b", "position": 1}, {"name": "a", "position": 0}]}}, "result": {"data_array": [["1", "x"]]}}))
    (tmp_path / "c.json").write_text(json.dumps({"data_array": [["2", None]]}))
    got = readers.statement_rows(spark, str(tmp_path / "s.json"), str(tmp_path / "c.json"))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("1", "x"), ("2", None)]
    contracts = spark.createDataFrame([("s", "CH", "load", "MW"), ("s", "CH", "load", "kW")], "source_id string, country string, domain string, unit string")
    assert readers.source_contracts(contracts).first().units == ["MW", "kW"]
    with pytest.raises(Refused):
        readers.source_contracts(contracts.unionByName(contracts.withColumn("country", F.lit("DE"))))
    assert readers.column_number("A1") == 0 and readers.column_number("Z9") == 25 and readers.column_number("AA10") == 26 and readers.column_number("BC7") == 54


def test_tables_by_range_and_family(spark):
    spark.range(48).select((F.lit("2024-07-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"), (F.col("id") * 1.0).alias("generation_forecast"), F.lit("x").alias("note")).createOrReplaceTempView("range_rows")
    plain = readers.table_range(spark, "range_rows", "ts", "2024-07-01 05:00:00", "2024-07-01 07:00:00")
    assert plain.columns == ["ts", "generation_forecast"] and sorted(r.generation_forecast for r in plain.collect()) == [5.0, 6.0]
    zoned = readers.table_range(spark, "range_rows", "ts", "2024-07-01 05:00:00", "2024-07-01 07:00:00", "Europe/Zurich")
    assert sorted((r.ts, r.generation_forecast) for r in zoned.collect()) == [(datetime(2024, 7, 1, 5), 7.0), (datetime(2024, 7, 1, 6), 8.0)]
    spark.sql("create database if not exists fam")
    spark.table("range_rows").write.mode("overwrite").saveAsTable("fam.gen_a")
    assert {r.table_name for r in readers.table_family(spark, "fam", "gen_", "ts", "generation_forecast").collect()} == {"gen_a"}
    with pytest.raises(Refused):
        readers.table_family(spark, "fam", "nothing", "ts", "generation_forecast")
    spark.sql("drop database fam cascade")


def test_synthetic_sources_depend_on_the_seed_alone(spark):
    a, b = readers.synthetic(spark, "2024-01-01", 200, 1), readers.synthetic(spark, "2024-01-01", 200, 1).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != sorted(map(str, readers.synthetic(spark, "2024-01-01", 200, 2).collect()))
    assert a.select("source_id").distinct().count() == 6 and not a.where("value is null").isEmpty() and not a.where("revision_sequence = 1").isEmpty()
    assert pit.as_of(a, F.lit("2024-01-05").cast("timestamp_ntz")).where("known_at > timestamp_ntz'2024-01-05'").isEmpty()


def test_recommendations(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.5, 0.5, 0.1), ("b", 0.1, None, 0.5, 0.1), ("c", 0.1, 0.01, 0.01, 0.001), ("d", 0.1, 0.5, 0.01, 0.001)], "feature_id string, missing_fraction double, pearson double, spearman double, mutual_information double")
    assert {r.feature_id: r.decision for r in feature_audit.recommend(rows).collect()} == {"a": "DROP", "b": "UNDECIDED", "c": "DROP", "d": "KEEP"}
    one = spark.createDataFrame([(1, "x")], "a int, b string").select(scalars.identity_hash(F.col("a"), F.col("b")).alias("h"), scalars.identity_hash(F.col("b"), F.col("a")).alias("g")).first()
    assert len(one.h) == 64 and one.h != one.g
