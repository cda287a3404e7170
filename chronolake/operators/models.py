"""Baselines as expressions; fitted models as one grouped map over (fold, target).

``by``: columns beside fold_id that tell series apart, such as a target's name; each is a problem of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..guards import refuse_if_any


def persistence(assigned: DataFrame, *by: str) -> DataFrame:
    """Each fold's label with the latest target time among its training rows, for every validation row."""
    keys = ["fold_id", *by]
    train = assigned.where("partition = 'train'").groupBy(*keys).agg(F.max_by("target", F.struct("target_time", "row_id")).alias("prediction"))
    return _evidence(assigned.where("partition = 'validation'").join(train, keys, "left"), "persistence", by)


def seasonal(assigned: DataFrame, hours: int, *by: str) -> DataFrame:
    """Training label exactly a season before, null where there is none: ``eligible`` then gives the candidate up."""
    keys = ["fold_id", *by, "target_time"]
    train = assigned.where("partition = 'train'").select("fold_id", *by, (F.col("target_time") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("target_time"), F.col("target").alias("prediction"))
    rows = assigned.where("partition = 'validation'").join(train, keys, "left")
    return _evidence(rows, f"seasonal_{hours}h", by)


def condition_mean(assigned: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean training label of the same condition, the fold's mean for a condition that training does not hold."""
    keys = ["fold_id", *by]
    train = assigned.where("partition = 'train'")
    own = train.groupBy(*keys, F.col(column).alias("_c")).agg(F.avg("target").alias("_own"))
    every = train.groupBy(*keys).agg(F.avg("target").alias("_all"))
    rows = assigned.where("partition = 'validation'").withColumn("_c", F.col(column)).join(own, [*keys, "_c"], "left").join(every, keys, "left")
    return _evidence(rows.withColumn("prediction", F.coalesce("_own", "_all")), f"{column}_mean", by)


def conditional(assigned: DataFrame, *columns: str, strict: bool = False) -> DataFrame:
    """Sorted training labels of the same condition, as an array ``values``; conditions match null to null.

    An unseen condition has no values, or with ``strict`` is refused.
    """
    train = assigned.where("partition = 'train'").groupBy("fold_id", *columns).agg(F.array_sort(F.collect_list("target")).alias("values"))
    v, t = assigned.where("partition = 'validation'").alias("v"), train.alias("t")
    on = F.col("v.fold_id") == F.col("t.fold_id")
    for c in columns:
        on = on & F.col(f"v.{c}").eqNullSafe(F.col(f"t.{c}"))
    out = v.join(t, on, "left").select("v.*", "t.values")
    return refuse_if_any(out, unseen_condition=F.col("values").isNull()) if strict else out


def _evidence(rows: DataFrame, model: str, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.select("fold_id", *by, "row_id", F.lit(model).alias("model_id"), "issue_time", "target_time", F.col("target").alias("truth"), "prediction")


def eligible(evidence: DataFrame, *by: str) -> DataFrame:
    """Evidence of the models that predicted every case, so that all are compared on the same ones."""
    broken = evidence.where("prediction is null or isnan(prediction)").select(*by, "model_id").distinct()
    return evidence.join(broken, [*by, "model_id"], "left_anti")


# -- fitted models


class Ridge:
    """Drops columns without values, fills with means, scales by population deviation, and penalises slopes only."""

    def __init__(self, penalty: float = 10.0) -> None:
        self.penalty = penalty

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.used = ~np.isnan(x).all(0)
        x = x[:, self.used]
        self.fill = np.nanmean(x, 0) if x.size else np.zeros(0)
        x = np.where(np.isnan(x), self.fill, x)
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd == 0, 1.0, sd)
        z = (x - self.mean) / self.sd
        self.level = y.mean()
        self.slope = np.linalg.solve(z.T @ z + self.penalty * np.eye(z.shape[1]), z.T @ (y - self.level))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.used]
        return self.level + (np.where(np.isnan(x), self.fill, x) - self.mean) / self.sd @ self.slope


class BoostedTrees:
    """Least-squares boosting of shallow trees whose cuts lie at quantiles of distinct values."""

    def __init__(self, trees: int = 24, rate: float = 0.05, depth: int = 2, leaf: int = 8) -> None:
        self.trees, self.rate, self.depth, self.leaf = trees, rate, depth, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.used = ~np.isnan(x).all(0)
        x = x[:, self.used]
        self.fill = np.nanmean(x, 0) if x.size else np.zeros(0)
        x = np.where(np.isnan(x), self.fill, x)
        cuts = []
        for j in range(x.shape[1]):
            u = np.unique(x[:, j])
            cuts.append(np.unique(u[[min(len(u) - 1, int(q * (len(u) - 1))) for q in (0.1, 0.3, 0.5, 0.7, 0.9)]]))
        self.base, self.roots = y.mean(), []
        now = np.full(len(y), self.base)
        for _ in range(self.trees):
            root = self._grow(x, y - now, cuts, self.depth)
            self.roots.append(root)
            now = now + self.rate * self._value(root, x)
        return self

    def _grow(self, x, r, cuts, depth):
        best = None
        if depth and len(r) >= 2 * self.leaf:
            for j, own in enumerate(cuts):
                for c in own:
                    left = x[:, j] <= c
                    k = int(left.sum())
                    if k < self.leaf or len(r) - k < self.leaf:
                        continue
                    gain = r[left].sum() ** 2 / k + r[~left].sum() ** 2 / (len(r) - k)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, j, c)
        if best is None:
            return float(r.mean())
        _, j, c = best
        left = x[:, j] <= c
        return j, c, self._grow(x[left], r[left], cuts, depth - 1), self._grow(x[~left], r[~left], cuts, depth - 1)

    def _value(self, node, x):
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        j, c, a, b = node
        return np.where(x[:, j] <= c, self._value(a, x), self._value(b, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.used]
        x = np.where(np.isnan(x), self.fill, x)
        return self.base + self.rate * sum(self._value(t, x) for t in self.roots)


def fitted(assigned: DataFrame, model_id: str, make, *by: str) -> DataFrame:
    """Out-of-fold predictions of a fresh model for each fold and series; its rows are bounded by the plan's lengths.

    Truth never reaches ``predict``.  Where training has fewer than two labels, predictions are null.
    """
    keys = ["fold_id", *by]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        train, ask = rows[(rows["partition"] == "train") & rows["target"].notna()], rows[rows["partition"] == "validation"]
        out = {k: v for k, v in zip(keys, key, strict=True)} | {"row_id": ask["row_id"], "prediction": np.full(len(ask), np.nan)}
        if len(train) >= 2 and len(ask):
            x = lambda r: np.array(r["features"].tolist(), float)
            out["prediction"] = make().fit(x(train), train["target"].to_numpy(float)).predict(x(ask))
        return pd.DataFrame(out)

    kinds = ", ".join(f"{k} {assigned.schema[k].dataType.simpleString()}" for k in keys)
    found = assigned.select(*keys, "row_id", "partition", "features", "target").groupBy(*keys).applyInPandas(run, f"{kinds}, row_id string, prediction double")
    rows = assigned.where("partition = 'validation'").join(found, [*keys, "row_id"], "left")
    return _evidence(rows.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction"))), model_id, by)


# -- evaluation


def scoreboard(evidence: DataFrame, *keys: str) -> DataFrame:
    e = F.col("prediction") - F.col("truth")
    return evidence.groupBy(*(keys or ("model_id",))).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def pinball(truth: Column, prediction: Column, q: float) -> Column:
    return F.greatest(q * (truth - prediction), (q - 1) * (truth - prediction))


def champion(board: DataFrame, *by: str, score: str = "mae") -> DataFrame:
    """The model with the least score, ties by name, for each group or overall: an aggregation, not a sort."""
    return board.groupBy(*by).agg(F.min_by("model_id", F.struct(score, "model_id")).alias("model_id"), F.min(score).alias(score))


def causal_choice(weekly: DataFrame) -> DataFrame:
    """week and the model with the least mean score over the weeks before it. ``weekly``: week, model_id, mae."""
    past = Window.partitionBy("model_id").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    scored = weekly.withColumn("past", F.avg("mae").over(past)).where("past is not null")
    return scored.groupBy("week").agg(F.min_by("model_id", F.struct("past", "model_id")).alias("model_id"), F.min("past").alias("past_mae"))


def fold_summary(per_fold: DataFrame, *keys: str, metrics: tuple[str, ...] = ("mae",), worst: dict[str, str] | None = None) -> DataFrame:
    """Mean, median, worst and deviation of each metric over folds; ``worst``: "min" for metrics that should be high."""
    worst = worst or {}
    parts = []
    for m in metrics:
        bad = F.min(m) if worst.get(m) == "min" else F.max(m)
        parts += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median"), bad.alias(f"{m}_worst"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*keys).agg(*parts)


def stability(per_fold: DataFrame, metric: str, *keys: str) -> DataFrame:
    """1 for a metric that is the same in every fold, towards 0 as it varies."""
    return per_fold.groupBy(*keys).agg((1 / (1 + F.stddev_pop(metric))).alias("stability"))


def ablation(board: DataFrame, base: str, candidate: str, *keys: str) -> DataFrame:
    """Gain of the candidate scenario over the base, positive where it is better."""
    side = lambda s, n: board.where(F.col("scenario") == s).select(*keys, F.col("mae").alias(n))
    return side(base, "base_mae").join(side(candidate, "candidate_mae"), list(keys)).withColumn("gain", F.col("base_mae") - F.col("candidate_mae"))
