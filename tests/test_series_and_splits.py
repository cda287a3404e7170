import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.functions import scalars
from chronolake.operators import series, splits

T = datetime(2026, 1, 1)
H = timedelta(hours=1)


def at(t):
    return F.lit(str(t)).cast("timestamp_ntz")


def test_elapsed_window_is_half_open_and_null_propagates(spark):
    rows = [("s", T + h * H, v) for h, v in ((0, 100.0), (1, 100.0), (2, 2.0), (4, 4.0), (6, None))]
    out = {r.t: r for r in series.elapsed_window(spark.createDataFrame(rows, "k string, t timestamp_ntz, value double"), ["k"], "t", 3).collect()}
    now = out[T + 4 * H]
    assert (now.w_mean, now.w_std, now.w_min, now.w_max) == (3.0, 1.0, 2.0, 4.0)
    assert out[T + 6 * H].w_mean is None


def test_elapsed_window_merges_running_parts(spark, capsys):
    rng = random.Random(5)
    rows = [("ab"[k % 2], T + timedelta(minutes=15 * rng.randrange(4 * 40)), rng.choice([7.1, 7.1, 1e9 + rng.random(), None if rng.random() < 0.1 else -3.0])) for k in range(400)]
    rows += [("c", T + 6 * H - timedelta(microseconds=1), 0.1), ("c", T + 6 * H, 0.1), ("c", T + 6 * H, 0.1), ("c", T + 12 * H - timedelta(microseconds=1), 0.1), ("d", None, 1.0), ("d", None, 4.0), ("d", T, 9.0), ("e", None, None), ("e", datetime(1969, 12, 31, 23), 2.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, t timestamp_ntz, value double, id int")
    for hours in (1, 6, 30):
        wide = series.elapsed_window(df, ["k"], "t", hours)
        assert wide.columns == [*df.columns, "w_mean", "w_std", "w_min", "w_max"]
        out = wide.collect()
        assert sorted(r.id for r in out) == list(range(len(rows)))
        for r in out:
            inside = [v for k, t, v in rows if k == r.k and (t is r.t if None in (t, r.t) else r.t - hours * H < t <= r.t)]
            got = (r.w_mean, r.w_std, r.w_min, r.w_max)
            if None in inside:
                assert got == (None,) * 4
            else:
                assert got == pytest.approx((statistics.fmean(inside), statistics.pstdev(inside), min(inside), max(inside)), rel=1e-12, abs=1e-12)
    # a frame that ends at the row and starts anywhere but at its partition's start is summed anew for each row
    wide.explain(True)
    frames = re.findall(r"specifiedwindowframe\((.*?)\)", capsys.readouterr().out)
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_rate_needs_both_ends(spark):
    rows = [("s", T + h * H, v) for h, v in ((0, 1.0), (2, 3.0), (3, 9.0))]
    out = {r.hour: r.rate for r in series.rate_of_change(spark.createDataFrame(rows, "k string, hour timestamp_ntz, value double"), ["k"], 2).collect()}
    assert out[T + 2 * H] == 2 / 7200 and out[T + 3 * H] is None


def test_hour_needs_each_quarter_once(spark):
    q = timedelta(minutes=15)
    full = [("a", T + k * q, float(k)) for k in range(4)]
    twice = [("b", T + min(k, 3) * q, 1.0) for k in range(5)]
    short = [("c", T + k * q, 1.0) for k in range(3)]
    out = series.complete_hourly_mean(spark.createDataFrame(full + twice + short, "k string, t timestamp_ntz, value double"), "t", ["k"], "value").collect()
    assert [(r.k, r.value) for r in out] == [("a", 1.5)]


def test_fallback_order(spark):
    hist = [("s", T + h * H, float(h)) for h in range(0, 340) if h not in (172,)]
    df = spark.createDataFrame(hist, "k string, hour timestamp_ntz, value double")
    want = spark.createDataFrame([("s", T + 340 * H), ("s", T + 341 * H), ("s", T + 900 * H)], "k string, hour timestamp_ntz")
    out = {r.hour: (r.label, r.value) for r in series.seasonal_fallback(want, df, ["k"], at(T + 339 * H)).collect()}
    assert out[T + 340 * H] == ("nearby_167h", 173.0)
    assert out[T + 341 * H] == ("exact_168h", 173.0)
    assert out[T + 900 * H] == ("latest_causal", 339.0)


def test_rolling_origin_matches_the_published_example(spark):
    plan = splits.Plan(T + 10 * H, T + 40 * H, 10 * H, 4 * H, 2 * H, 10 * H, H, H, H)
    rows = [(str(i), T + i * H, T + i * H + H / 2, T + i * H, T + (i + 1) * H) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id string, issue_time timestamp_ntz, target_time timestamp_ntz, feature_known_at timestamp_ntz, label_known_at timestamp_ntz")
    assert len(plan.folds()) == 3
    got = splits.assign(df, plan).where("fold_id = 0").collect()
    ids = lambda p: sorted(int(r.row_id) for r in got if r.partition == p)
    assert ids("train") == list(range(8)) and ids("validation") == [10, 11, 12, 13] and ids("calibration") == [15, 16]
    close = splits.Plan(T + 10 * H, T + 40 * H, 10 * H, 4 * H, 2 * H, H, H, H, H)
    assert close.folds()[1]["val_start"] == T + 20 * H


def test_local_time_gaps_and_repeats(spark):
    one = lambda text: spark.range(1).select(scalars.local_to_utc(F.lit(text).cast("timestamp_ntz"), "Europe/Zurich").alias("t")).collect()[0].t
    assert one("2026-03-29 01:45:00") == datetime(2026, 3, 29, 0, 45)
    assert one("2026-03-29 03:00:00") == datetime(2026, 3, 29, 1, 0)
    for bad in ("2026-03-29 02:00:00", "2025-10-26 02:00:00"):
        with pytest.raises(Exception, match="local time"):
            one(bad)


def test_numbers_and_quantiles(spark):
    row = spark.range(1).select(
        *(scalars.number(F.lit(x)).alias(f"n{i}") for i, x in enumerate(["1,234.5", " ", "NaN", "inf", "x", None])),
        scalars.array_quantile(F.array(*map(F.lit, (1.0, 2.0, 3.0, 10.0))), 0.1).alias("q"), scalars.even_round(F.lit(2.5)).alias("r"),
    ).first()
    assert [row[f"n{i}"] for i in range(6)] == [1234.5, None, None, None, None, None]
    assert abs(row.q - 1.3) < 1e-12 and row.r == 2


def test_position_and_weekly_folds(spark):
    hours = spark.createDataFrame([(T + k * H,) for k in range(100) if k != 60], "hour timestamp_ntz")
    out = splits.weekly_folds(hours, 24, 12, 12).collect()
    assert [((r.fold_start - T) // H, r.rows) for r in sorted(out)] == [(0, 36), (12, 36), (24, 36)]
    folds = splits.position_folds(hours, at(T + 50 * H), 2, train_hours=20, week=10)
    n = {(r.fold, r.part): r["count"] for r in folds.groupBy("fold", "part").count().collect()}
    assert n == {(1, "train"): 20, (1, "forecast"): 10, (2, "train"): 20, (2, "forecast"): 10}
