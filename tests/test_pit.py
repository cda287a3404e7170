from datetime import datetime, timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from chronolake.guards import Refused
from chronolake.operators import pit, quality

T = datetime(2026, 1, 1)
H = timedelta(hours=1)
SCHEMA = "source_id string, source_record_id string, revision_sequence int, event_time timestamp_ntz, known_at timestamp_ntz, value double, unit string, event_id long"


def row(seq, known, value=1.0, source="a", record="r", event=T, unit="MW", event_id=0):
    return (source, record, seq, event, known, value, unit, event_id)


def at(t):
    return F.lit(str(t)).cast("timestamp_ntz")


def test_boundary_is_inclusive_and_order_does_not_matter(spark):
    rows = [row(0, T, 1.0), row(1, T + H, 2.0), row(0, T, 5.0, source="b")]
    for some in permutations(rows):
        df = spark.createDataFrame(list(some), SCHEMA)
        assert {r.source_id: r.value for r in pit.as_of(df, at(T)).collect()} == {"a": 1.0, "b": 5.0}
        assert {r.source_id: r.value for r in pit.as_of(df, at(T + H)).collect()} == {"a": 2.0, "b": 5.0}


def test_late_old_revision_never_wins(spark):
    df = spark.createDataFrame([row(1, T, 2.0), row(0, T + H, 1.0)], SCHEMA)
    assert [r.value for r in pit.as_of(df, at(T + 5 * H)).collect()] == [2.0]
    issues = spark.createDataFrame([(T,), (T + 2 * H,)], "issue timestamp_ntz")
    assert {r.revision_sequence for r in pit.as_of_many(df, issues).collect()} == {1}


def test_conflicts_count_only_when_eligible(spark):
    df = spark.createDataFrame([row(0, T, 1.0), row(0, T + 2 * H, 3.0), row(0, T, 1.0)], SCHEMA)
    assert pit.resolve(df, at(T + H), "value", "unit").count() == 1
    with pytest.raises(Refused):
        pit.resolve(df, at(T + 2 * H), "value", "unit")


def test_many_issues_equal_one_by_one(spark):
    rows = [row(k % 4, T + (k * 7 % 90) * H, float(k), source="ab"[k % 2], record=f"r{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    issues = spark.createDataFrame([(T + 25 * k * H,) for k in range(5)], "issue timestamp_ntz")
    got = sorted((r.issue, r.source_id, r.source_record_id, r.revision_sequence) for r in pit.as_of_many(df, issues).collect())
    want = [(T + 25 * k * H, r.source_id, r.source_record_id, r.revision_sequence) for k in range(5) for r in pit.as_of(df, at(T + 25 * k * H)).collect()]
    assert got == sorted(want)


def test_membership_and_units_are_refused(spark):
    df = spark.createDataFrame([row(0, T)], SCHEMA)
    with pytest.raises(Refused):
        pit.dataset_as_of(df, spark.createDataFrame([("b", ["MW"])], "source_id string, units array<string>"), at(T))
    with pytest.raises(Refused):
        pit.dataset_as_of(df, spark.createDataFrame([("a", ["kW"])], "source_id string, units array<string>"), at(T))


def test_gaps_cross_days_and_audit_counts(spark):
    times = [0, 1, 2, 5, 5, 30]
    rows = [row(1 if k == 4 else 0, T, None if k == 3 else 1.0, record=f"r{min(k, 3) if k < 5 else k}", event=T + h * H, event_id=k) for k, h in enumerate(times)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.gap_us // 3_600_000_000 for r in quality.gaps(df).where("gap_us is not null").collect()) == [1, 1, 3, 25]
    report = quality.audit(df, at(T + 2 * H), [3, 28])
    assert report["missingness"][0]["missing"] == 1
    assert report["revisions"][0]["revised_series"] == 1
    assert report["future"][0]["future_rows"] == 3
    assert {r["horizon"]: r["available"] for r in report["horizons"]} == {3: True, 28: True}
