"""Out-of-fold evidence: execution with provenance, revalidation, selection of champions and the joint handoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..guards import Refused
from . import models
from .splits import Plan


def hide_truth(rows: DataFrame) -> DataFrame:
    """What a model may see of the rows that it predicts: no label, and no time at which the label becomes known."""
    return rows.withColumns({"target": F.lit(None).cast(rows.schema["target"].dataType), "label_known_at": F.col("target_time")})


def set_hash(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """``hash`` of the rows of each group as a multiset: their number and sums of two parts of each row's sha256.

    Sums combine in any order and in parts, so no group is sorted or held by one task.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    part = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    hashed = rows.select(*keys, F.sha2(text, 256).alias("_h"))
    return hashed.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(16)), 256).alias("hash"))


def point_candidates(assigned: DataFrame, season: int, condition: str, *by: str) -> DataFrame:
    """Evidence of the baselines for every validation case, whether they predict it or not."""
    return reduce(DataFrame.unionByName, (models.persistence(assigned, *by), models.seasonal(assigned, season, *by), models.condition_mean(assigned, condition, *by)))


def execute(assigned: DataFrame, evidence: DataFrame, plan: Plan, versions: dict[str, str], feature_hash: str, *by: str, payload: tuple[str, ...] = ("row_id", "target")) -> DataFrame:
    """Evidence as records: with version, training cutoff and the hashes of features and training rows.

    A fold without training or validation rows is refused.
    """
    keys = ["fold_id", *by]
    empty = assigned.groupBy(*keys).agg(F.count_if(F.col("partition") == "train").alias("t"), F.count_if(F.col("partition") == "validation").alias("v")).where("t = 0 or v = 0")
    if not empty.isEmpty():
        raise Refused("a fold without training or validation rows")
    trained = set_hash(assigned.where("partition = 'train'"), list(payload), *keys).withColumnRenamed("hash", "training_hash")
    version = F.create_map(*(F.lit(x) for pair in versions.items() for x in pair))
    rows = evidence.join(trained, keys)
    return rows.select(*evidence.columns, version[F.col("model_id")].alias("version"), cutoff(plan, evidence).alias("training_cutoff"), F.lit(feature_hash).alias("feature_hash"), "training_hash")


def cutoff(plan: Plan, rows: DataFrame) -> Column:
    """The end of training of each row's fold; null for a fold that the plan does not have."""
    kind = rows.schema["issue_time"].dataType
    return F.create_map(*(x for f in plan.folds() for x in (F.lit(f["fold_id"]), F.lit(f["train_end"].isoformat(sep=" ")).cast(kind))))[F.col("fold_id")]


def revalidate(records: DataFrame, assigned: DataFrame, plan: Plan, versions: dict[str, str], feature_hash: str, *by: str, payload: tuple[str, ...] = ("row_id", "target")) -> DataFrame:
    """check and broken: how many records, or samples, break each rule of out-of-fold evidence."""
    keys = ["fold_id", *by]
    cases = assigned.where("partition = 'validation'").select(*keys, "row_id", F.col("issue_time").alias("_issue"), F.col("target_time").alias("_time"), F.col("target").alias("_truth"))
    trained = set_hash(assigned.where("partition = 'train'"), list(payload), *keys).withColumnRenamed("hash", "_hash")
    own = F.create_map(*(F.lit(x) for pair in versions.items() for x in pair))[F.col("model_id")]
    rows = records.join(cases, [*keys, "row_id"], "left").join(trained, keys, "left").withColumns({"_cutoff": cutoff(plan, records), "_version": own})
    known = F.col("_issue").isNotNull()
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    checks = {
        "unknown fold": F.col("_cutoff").isNull(),
        "no validation case": ~known,
        "timestamps differ": known & (differ("issue_time", "_issue") | differ("target_time", "_time")),
        "truth differs": known & differ("truth", "_truth"),
        "chronology": ~((F.col("training_cutoff") <= F.col("issue_time")) & (F.col("issue_time") < F.col("target_time"))),
        "training cutoff differs": differ("training_cutoff", "_cutoff"),
        "training rows differ": differ("training_hash", "_hash"),
        "features differ": ~F.col("feature_hash").eqNullSafe(F.lit(feature_hash)),
        "no digest": ~(F.col("feature_hash").rlike("^[0-9a-f]{64}$") & F.col("training_hash").rlike("^[0-9a-f]{64}$")),
        "unregistered candidate": F.col("_version").isNull() | F.col("version").isNull(),
        "version differs": F.col("_version").isNotNull() & differ("version", "_version"),
        "no finite prediction": F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf")),
    }
    n = {name: f"_{i}" for i, name in enumerate(checks)}
    one = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.coalesce(c, F.lit(True))).alias(n[name]) for name, c in checks.items()))
    twice = records.groupBy(*keys, "row_id", "model_id", "version").count().where("count > 1").agg(F.count(F.lit(1)).alias("_twice"))
    sample = F.struct(*(F.col(c) for c in ("issue_time", "target_time", "target")))
    unsteady = assigned.groupBy(*by, "row_id").agg(F.min(sample).alias("_a"), F.max(sample).alias("_b")).where("_a <> _b").agg(F.count(F.lit(1)).alias("_unsteady"))
    named = [F.struct(F.lit("no records").alias("check"), F.when(F.col("_rows") == 0, 1).otherwise(0).cast("bigint").alias("broken"))]
    named += [F.struct(F.lit(name).alias("check"), F.col(c).alias("broken")) for name, c in n.items()]
    named += [F.struct(F.lit("predicted twice").alias("check"), F.col("_twice").alias("broken")), F.struct(F.lit("sample differs between folds").alias("check"), F.col("_unsteady").alias("broken"))]
    return one.crossJoin(F.broadcast(twice)).crossJoin(F.broadcast(unsteady)).select(F.explode(F.array(*named)).alias("c")).select("c.*")  # one row each


def require_valid(checks: DataFrame) -> None:
    """Refuses evidence that breaks a rule. ``checks``: the rows of ``revalidate``."""
    broken = {r["check"]: r["broken"] for r in checks.where("broken > 0").collect()}
    if broken:
        raise Refused("; ".join(f"{k}: {n}" for k, n in sorted(broken.items())))


def coverage(evidence: DataFrame, assigned: DataFrame, *by: str) -> DataFrame:
    """Per series and model: validation cases without a prediction, and predictions of no validation case."""
    keys = ["fold_id", *by, "row_id"]
    wanted = evidence.select(*by, "model_id").distinct().join(assigned.where("partition = 'validation'").select(*keys).distinct(), list(by)) if by else evidence.select("model_id").distinct().crossJoin(F.broadcast(assigned.where("partition = 'validation'").select(*keys).distinct()))
    marked = wanted.withColumn("_want", F.lit(1)).unionByName(evidence.where("prediction is not null").select(*by, "model_id", "fold_id", "row_id").withColumn("_want", F.lit(0)))
    each = marked.groupBy(*by, "model_id", "fold_id", "row_id").agg(F.max("_want").alias("_w"), F.min("_want").alias("_p"))
    return each.groupBy(*by, "model_id").agg(F.count_if(F.col("_p") == 1).alias("missing"), F.count_if(F.col("_w") == 0).alias("extra"))


def champions(summary: DataFrame, name: str, score: str = "mae_mean") -> DataFrame:
    """The model with the least score for each target, ties by name."""
    return summary.groupBy(name).agg(F.min_by("model_id", F.struct(score, "model_id")).alias("model_id"))


def selected(evidence: DataFrame, champion: DataFrame, name: str) -> DataFrame:
    """Each target's champion's predictions. ``champion``: a row for each target."""
    return evidence.join(F.broadcast(champion.select(name, "model_id")), [name, "model_id"])  # a row for each target


def joint(rows: DataFrame, name: str, targets: list[str]) -> DataFrame:
    """fold_id, timestamp, issue_time, horizon (hours) and actual, pred and residual of each target, in handoff order.

    ``rows``: the champions' evidence.  Refused: other targets, a target that lacks a case, a case predicted twice,
    a null, times that differ between targets, chronology, horizons that are no whole hours, and a timestamp in two
    folds.  One aggregation makes the rows and counts what is wrong with them.
    """
    own = lambda t, c: F.max(F.when(F.col(name) == t, F.col(c)))
    hours = (F.unix_micros(F.col("target_time").cast("timestamp")) - F.unix_micros(F.col("issue_time").cast("timestamp"))) / 3_600_000_000
    wide = rows.withColumn("_h", hours).groupBy("fold_id", "row_id").agg(
        F.max("target_time").alias("timestamp"), F.max("issue_time").alias("issue_time"), F.max("_h").alias("horizon"), F.min("target_time").alias("_t"), F.min("issue_time").alias("_i"),
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col(name).isin(*targets)).alias("_other"), F.count_if(F.col("truth").isNull() | F.col("prediction").isNull() | F.isnan("truth") | F.isnan("prediction")).alias("_null"),
        *(own(t, c).alias(f"{t}_{k}") for t in targets for c, k in (("truth", "actual"), ("prediction", "pred"))), F.count_distinct(F.col(name)).alias("_d"),
    )
    bad = {
        "unknown target": F.col("_other") > 0, "a target is missing or predicted twice": (F.col("_d") != len(targets)) | (F.col("_n") != len(targets)), "null or not finite": F.col("_null") > 0,
        "times differ between targets": (F.col("_t") != F.col("timestamp")) | (F.col("_i") != F.col("issue_time")), "chronology": F.col("horizon") <= 0, "horizon is no whole hour": F.col("horizon") != F.floor("horizon"),
    }
    seen = wide.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_k"), *(F.max(c.cast("int")).alias(f"_b{i}") for i, c in enumerate(bad.values()))).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_k") > 1).alias("_twice"), *(F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(bad)))).first()
    wrong = [n for i, n in enumerate(bad) if seen[f"_b{i}"]] + (["a timestamp in two folds"] if seen["_twice"] else []) + ([] if seen["_rows"] else ["no rows"])
    if wrong:
        raise Refused("; ".join(wrong))
    return wide.select("timestamp", "fold_id", F.col("horizon").cast("int").alias("horizon"), "issue_time", *(c for t in targets for c in (F.col(f"{t}_actual"), F.col(f"{t}_pred"), (F.col(f"{t}_actual") - F.col(f"{t}_pred")).alias(f"{t}_residual"))))


def handoff_columns(targets: list[str]) -> list[str]:
    return ["timestamp", "fold_id", "horizon", "issue_time", *(f"{t}_{k}" for t in targets for k in ("actual", "pred", "residual"))]


def require_handoff(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Refuses another order of columns; ``joint`` has refused an empty table."""
    if rows.columns != handoff_columns(targets):
        raise Refused("the handoff's columns are out of order")
    return rows


def residual_summary(handoff: DataFrame, targets: list[str]) -> DataFrame:
    """Per target: count, mae, rmse, bias (prediction less actual), mean and deviation of residuals."""
    long = handoff.select(F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"{t}_residual").alias("r")) for t in targets))).alias("x")).select("x.*")
    r = F.col("r")
    return long.groupBy("target").agg(F.count(r).alias("count"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(-r).alias("bias"), F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"))


def read_handoff(spark, path: str, targets: list[str]) -> DataFrame:
    """Residual panel of a handoff file: rows whose issue time is not before their timestamp are refused."""
    from ..guards import refuse_if_any

    schema = "timestamp timestamp_ntz, fold_id int, horizon double, issue_time timestamp_ntz, " + ", ".join(f"{t}_{k} double" for t in targets for k in ("actual", "pred", "residual"))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return refuse_if_any(rows, chronology=~(F.col("issue_time") < F.col("timestamp")), horizon=~(F.col("horizon") > 0))


def week_summary(weekly: DataFrame, holdout: int, *keys: str) -> DataFrame:
    """Mean of the weeks before the holdout week, its own score, and by how much it is worse. ``weekly``: week, score."""
    past = F.avg(F.when(F.col("week") < holdout, F.col("score")))
    last = F.max(F.when(F.col("week") == holdout, F.col("score")))
    return weekly.groupBy(*keys).agg(F.count_if(F.col("week") < holdout).alias("weeks"), past.alias("validation_score"), last.alias("holdout_score"), (last - past).alias("gap"))
