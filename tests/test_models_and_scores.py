import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.guards import Refused
from chronolake.operators import feature_audit, models, scoring, uncertainty

T = datetime(2026, 1, 1)
H = timedelta(hours=1)


def score(spark, samples, truth):
    return spark.range(1).select(scoring.distribution_score(F.array(*map(F.lit, samples)), F.lit(truth).cast("double")).alias("s")).first().s


def test_distribution_score_closed_forms(spark):
    assert abs(score(spark, [9, 10, 11] * 100, 10.0) - (0.2 + 0.45 + 0.35 * 2 / (2 + 2 * math.sqrt(2 / 3)))) < 1e-12
    assert abs(score(spark, [5] * 300, 5.0) - 1.0) < 1e-12
    assert score(spark, [9, 10, 11] * 100, 12.0) == 0.0
    assert score(spark, [9, 10, 11] * 100, None) == 0.0


def table(spark, n, samples=300, bad=None):
    rows = [(T + k * H, *[[1] * (samples if (k, c) != bad else samples - 1) for c in range(2)]) for k in range(n)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, CH array<int>, DE array<int>")


def test_submission_checks(spark):
    good = table(spark, 3)
    truth = spark.createDataFrame([(T + k * H, 1.0, 1.0) for k in range(3)], "timestamp timestamp_ntz, CH double, DE double")
    assert scoring.evaluate_submission(good, truth, ["CH", "DE"], expected_rows=3) == 1.0
    for broken in (table(spark, 2), table(spark, 3, bad=(1, 1)), good.select("timestamp", "DE", "CH"), good.unionByName(good.limit(1))):
        with pytest.raises(Refused):
            scoring.evaluate_submission(broken, truth, ["CH", "DE"], expected_rows=3)
    with pytest.raises(Refused):
        scoring.evaluate_submission(good, truth.limit(2), ["CH", "DE"], expected_rows=3)


def test_ridge_equals_normal_equations():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    x[:, 3] = np.nan
    y = x[:, :3] @ [1.0, -2.0, 0.5] + 3
    m = models.Ridge(0.0).fit(x, y)
    assert np.allclose(m.predict(x), y)
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(models.Ridge().fit(x, y).slope, want)


def test_boosting_learns_a_step():
    x = np.linspace(0, 1, 200)[:, None]
    y = (x[:, 0] > 0.5) * 10.0
    m = models.BoostedTrees(trees=60, rate=0.2).fit(x, y)
    assert np.abs(m.predict(x) - y).mean() < 0.5


def test_ranks_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 5.0)], "k string, u double, v double")
    out = {r.k: r for r in feature_audit.correlations(df, "u", "v", "k").collect()}
    assert abs(out["a"].spearman - 0.8660254) < 1e-6 and out["b"].pearson == 0.0


def test_draws_do_not_depend_on_partitions(spark):
    pts = spark.createDataFrame([(T + k * H, float(k), 2.0 * k) for k in range(40)], "hour timestamp_ntz, x double, y double")
    draw = lambda df: sorted((r.hour, r.x, r.y) for r in uncertainty.joint_samples(df, ["x", "y"], [0.5, 0.0], [[4.0, 3.0], [3.0, 9.0]], key="hour", seed=7, samples=50).collect())
    assert draw(pts.repartition(1)) == draw(pts.repartition(7))


def test_cholesky_and_scale():
    low = np.array(uncertainty.cholesky([[4.0, 2.0], [2.0, 1.0]]))
    assert np.allclose(low @ low.T, [[4, 2], [2, 1]])
    with pytest.raises(Refused):
        uncertainty.cholesky([[1.0, 2.0], [2.0, 1.0]])
    rng = np.random.default_rng(0)
    r = rng.normal(0, 2, 4000)
    s = uncertainty.calibrated_scale(np.full(4000, -1.645), np.full(4000, 1.645), r, coverage=0.9)
    assert abs(s - 4) < 0.4


def test_champion_breaks_ties_by_name(spark):
    board = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model_id string, mae double")
    assert models.champion(board).first().model_id == "a"
