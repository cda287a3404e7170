"""Feature diagnostics: correlation, rank correlation, mutual information and univariate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import cumulative


def pairs(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Finite pairs of doubles."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.select(*keys, a.alias("x"), b.alias("y")).where(ok(F.col("x")) & ok(F.col("y")))


def pearson(x: str = "x", y: str = "y") -> Column:
    """Null below two pairs, 0 where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) >= 2, F.when(spread == 0, 0.0).otherwise(F.try_divide(F.covar_pop(x, y), spread)))


def average_ranks(df: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """Mean rank of ties, from counts of distinct values: equal values are one row before anything is ranked."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranks = cumulative(counts, column, "_n", *keys).select(*keys, column, (F.col("below") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, column])


def correlations(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    found = pairs(df, x, y, *keys)
    ranked = average_ranks(average_ranks(found, "x", "rx", *keys), "y", "ry", *keys)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson().alias("pearson"), pearson("rx", "ry").alias("spearman"))


def mutual_information(df: DataFrame, x: str, y: str, *keys: str, bins: int = 5) -> DataFrame:
    """Natural-log mutual information of equal-width bins; 0 where either side is constant."""
    found = pairs(df, x, y, *keys)
    ends = found.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    b = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins).cast("int"))).otherwise(0)
    binned = found.join(F.broadcast(ends) if not keys else ends, list(keys)) if keys else found.crossJoin(F.broadcast(ends))
    cells = binned.groupBy(*keys, b("x", "x0", "x1").alias("bx"), b("y", "y0", "y1").alias("by")).agg(F.count(F.lit(1)).alias("c"))
    px, py, all_ = (F.sum("c").over(Window.partitionBy(*keys, *k)) for k in (["bx"], ["by"], []))
    terms = cells.select(*keys, "c", px.alias("cx"), py.alias("cy"), all_.alias("n"))
    return terms.groupBy(*keys).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mutual_information"))


def univariate_oof(assigned: DataFrame, feature: str) -> DataFrame:
    """Mean absolute error of the feature value's training mean, the fold's mean for unseen values; null matches null."""
    train = assigned.where("partition = 'train'")
    own = train.groupBy("fold_id", F.col(feature).alias("_f")).agg(F.avg("target").alias("_own"))
    all_ = train.groupBy("fold_id").agg(F.avg("target").alias("_all"))
    rows = assigned.where("partition = 'validation'").alias("v").join(own.alias("t"), (F.col("v.fold_id") == F.col("t.fold_id")) & F.col(f"v.{feature}").eqNullSafe(F.col("t._f")), "left").select("v.*", "_own").join(all_, "fold_id")
    return rows.groupBy("fold_id").agg(F.avg(F.abs(F.coalesce("_own", "_all") - F.col("target"))).alias("mae"), F.count(F.lit(1)).alias("rows"))


def report(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Missing share, correlation, rank correlation and mutual information of each feature with the target."""
    bad = F.col(x).isNull() | F.isnan(F.col(x).cast("double"))
    missing = df.groupBy(*keys).agg((F.count_if(bad) / F.count(F.lit(1))).alias("missing_fraction"))
    found = correlations(df, x, y, *keys).join(mutual_information(df, x, y, *keys), list(keys))
    return missing.join(found, list(keys), "left")


def recommend(audited: DataFrame, *, most_missing: float = 0.5, least_abs: float = 0.05, least_mi: float = 0.01) -> DataFrame:
    """KEEP, DROP or UNDECIDED by an ordered chain."""
    weak = (F.abs("pearson") < least_abs) & (F.abs("spearman") < least_abs) & (F.col("mutual_information") < least_mi)
    unknown = F.col("pearson").isNull() | F.col("mutual_information").isNull()
    return audited.withColumn("decision", F.when(F.col("missing_fraction") > most_missing, "DROP").when(unknown, "UNDECIDED").when(weak, "DROP").otherwise("KEEP"))
