"""Scores of sample distributions, and the checks that a table of them must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, NumericType

from ..guards import Refused, refuse_if_any

#: Weights of capture, goodness and sharpness, and deviations at which goodness ends.
WEIGHTS = (0.2, 0.45, 0.35)
REACH = 3.0


def array_mean(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)


def array_std(samples: Column) -> Column:
    """Population deviation."""
    mean = array_mean(samples)
    return F.sqrt(F.aggregate(F.transform(F.array(mean), lambda m: F.aggregate(samples, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))), F.lit(0.0), lambda a, x: a + x) / F.size(samples))


def distribution_score(samples: Column, truth: Column) -> Column:
    """0 unless the truth lies within the samples' range; else weighted capture, goodness and sharpness.

    Goodness falls from 1 at the mean to 0 at REACH deviations; sharpness is the range against itself and two
    deviations.  Samples without spread have full sharpness, and goodness only if they equal the truth.
    """
    low, high = F.array_min(samples).cast("double"), F.array_max(samples).cast("double")
    mean, sd = array_mean(samples), array_std(samples)
    flat = sd == 0
    goodness = F.when(flat, F.when(truth == mean, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(truth - mean), REACH * sd)))
    sharpness = F.when(flat, 1.0).otherwise(F.try_divide(high - low, high - low + 2 * sd))
    inside = F.coalesce(truth.between(low, high), F.lit(False))
    capture, good, sharp = WEIGHTS
    return F.when(inside, capture + good * goodness + sharp * sharpness).otherwise(0.0)


def score_table(predictions: DataFrame, truths: DataFrame, targets: list[str], key: str = "timestamp") -> DataFrame:
    """Per timestamp the mean score over targets; the two tables must have the same timestamps."""
    p = predictions.select(key, *(F.col(t).alias(f"p_{t}") for t in targets))
    r = truths.select(key, *(F.col(t).cast("double").alias(f"r_{t}") for t in targets))
    parts = [distribution_score(F.col(f"p_{t}"), F.col(f"r_{t}")) for t in targets]
    return p.join(r, key).select(key, (sum(parts[1:], parts[0]) / len(parts)).alias("score"))


def evaluate_submission(predictions: DataFrame, truths: DataFrame, targets: list[str], key: str = "timestamp", expected_rows: int | None = 168) -> float:
    """The table's score, after every check."""
    validate_predictions(predictions, targets, key, expected_rows)
    require_same_keys(predictions, truths, key)
    row = score_table(predictions, truths, targets, key).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s")).first()
    if expected_rows is not None and row["n"] != expected_rows:
        raise Refused(f"{row['n']} scored rows; expected {expected_rows}")
    return row["s"]


def validate_predictions(df: DataFrame, targets: list[str], key: str = "timestamp", rows: int | None = 168, samples: int = 300) -> DataFrame:
    """Column order, types, row count, unique keys, sizes and nulls, in a schema check and one pass."""
    if df.columns != [key, *targets]:
        raise Refused(f"columns {df.columns}; expected {[key, *targets]}")
    wrong = [t for t in targets if not isinstance(df.schema[t].dataType, ArrayType) or not isinstance(df.schema[t].dataType.elementType, IntegerType)]
    if wrong:
        raise Refused(f"no integer arrays: {wrong}")
    got = submission_counts(df, targets, key, samples).first()
    if not got["rows"] or (rows is not None and got["rows"] != rows) or got["keys"] != got["rows"] or got["broken"]:
        raise Refused(f"rows {got['rows']}, distinct {got['keys']}, broken {got['broken']}")
    return df


def submission_counts(df: DataFrame, targets: list[str], key: str, samples: int) -> DataFrame:
    """One row: rows, distinct keys, and rows with a null or wrongly sized array."""
    bad = F.col(key).isNull()
    for t in targets:
        bad = bad | F.col(t).isNull() | (F.size(t) != samples) | F.exists(t, lambda x: x.isNull())
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.coalesce(bad, F.lit(True))).alias("broken"))


def validate_realizations(df: DataFrame, targets: list[str], key: str = "timestamp") -> DataFrame:
    if df.columns != [key, *targets] or any(not isinstance(df.schema[t].dataType, NumericType) for t in targets):
        raise Refused("realizations need the key and one number for each target")
    return refuse_if_any(df, null_key=F.col(key).isNull())


def unmatched_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).join(b.select(*keys), list(keys), "left_anti")


def require_same_keys(a: DataFrame, b: DataFrame, *keys: str) -> None:
    for x, y, name in ((a, b, "without a realization"), (b, a, "without a prediction")):
        if not unmatched_keys(x, y, *keys).isEmpty():
            raise Refused(f"{', '.join(keys)} {name}")


def mean_rmse(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: the root mean square error of the samples' means over all (samples, truth) columns together."""
    errors = F.array(*(array_mean(F.col(s)) - F.col(t) for s, t in pairs))
    return df.select(F.explode(errors).alias("e")).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


def week_metrics(df: DataFrame, truth: str, low: str, point: str, high: str, *keys: str) -> DataFrame:
    """Capture (inclusive), sharpness, mae and bias of a central interval and its point; crossed bounds are refused."""
    checked = df.withColumn("_ok", F.when(F.col(low) > F.col(high), F.raise_error(F.lit("crossed bounds"))).otherwise(F.lit(True))).where("_ok")
    e = F.col(point) - F.col(truth)
    return checked.groupBy(*keys).agg(F.avg(F.when(F.col(truth).between(F.col(low), F.col(high)), 1.0).otherwise(0.0)).alias("capture"), F.avg(F.col(high) - F.col(low)).alias("sharpness"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def integer_samples(values: Column, policy: str = "nearest") -> Column:
    """Samples as integers: halves to even, or only values that are integers already."""
    if policy == "exact":
        return F.when(F.exists(values, lambda x: x != F.floor(x)), F.raise_error(F.lit("samples are no integers"))).otherwise(F.transform(values, lambda x: x.cast("int")))
    return F.transform(values, lambda x: F.rint(x).cast("int"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """Counts and shares of equal bins; the highest value belongs to the last bin."""
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1)).cast("bigint")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total")) if keys else None
    if keys:
        return counts.join(total, list(keys)).select(*keys, "bin", "n", (F.col("n") / F.col("total")).alias("p"))
    n = df.where(F.col(value).isNotNull()).count()
    return counts.select("bin", "n", (F.col("n") / F.lit(max(1, n))).alias("p"))


def repaired_quantiles(values: Column) -> Column:
    """Quantiles raised to the running maximum, so that they never cross."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.greatest(x, F.coalesce(F.get(a, F.size(a) - 1), x)))))


def sign_probabilities(df: DataFrame, value: str, *keys: str) -> DataFrame:
    p = F.avg(F.when(F.col(value) >= 0, 1.0).otherwise(0.0))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(p.alias("export"), (1 - p).alias("import"))


def interval_metrics(df: DataFrame, truth: str, low: str, high: str, *keys: str) -> DataFrame:
    """Inclusive coverage and mean width; crossed bounds are refused."""
    df = df.withColumn("_ok", F.when(F.col(low) > F.col(high), F.raise_error(F.lit("crossed bounds"))).otherwise(F.lit(True))).where("_ok")
    return df.groupBy(*keys).agg(F.avg(F.when(F.col(truth).between(F.col(low), F.col(high)), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("sharpness"))


def brier(truth: Column, probability: Column) -> Column:
    return F.avg((probability - truth) * (probability - truth))


def submission_table(rows: DataFrame, targets: list[str], key: str = "timestamp", rows_expected: int | None = 168, samples: int = 300) -> DataFrame:
    """timestamp, target_0, target_1, ... in the order of ``targets``, checked: scores map columns by position."""
    missing = [t for t in targets if t not in rows.columns]
    if missing or len(set(targets)) != len(targets):
        raise Refused(f"missing or repeated targets: {missing or targets}")
    table = rows.select(F.col(key).alias("timestamp"), *(F.col(t).alias(f"target_{i}") for i, t in enumerate(targets)))
    return validate_predictions(table, [f"target_{i}" for i in range(len(targets))], rows=rows_expected, samples=samples)


def records_of(outputs: DataFrame, targets: list[str], key: str = "timestamp", name: str = "target", samples: str = "samples") -> DataFrame:
    """One row for each timestamp from a row for each timestamp and target; a missing, repeated or other target is refused."""
    wide = outputs.groupBy(key).agg(*(F.max(F.when(F.col(name) == t, F.col(samples))).alias(t) for t in targets), F.count(F.lit(1)).alias("_n"), F.count_distinct(name).alias("_d"))
    lacking = F.lit(False)
    for t in targets:
        lacking = lacking | F.col(t).isNull()
    from ..guards import refuse_if_any

    return refuse_if_any(wide, missing_or_repeated_target=lacking | (F.col("_n") != len(targets)) | (F.col("_d") != len(targets))).drop("_n", "_d")
