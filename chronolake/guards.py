"""Fail-closed checks: one aggregated action each, never a loop over rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


class Refused(ValueError):
    """Input that breaks a contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise Refused(f"missing columns: {', '.join(missing)}")
    return df


def refuse_if_any(df: DataFrame, **checks: Column) -> DataFrame:
    """Raises if any row meets a check; all checks share one pass."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items())).first()
    bad = {n: row[n] for n in checks if row[n]}
    if bad:
        raise Refused("; ".join(f"{n}: {k} rows" for n, k in sorted(bad.items())))
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise Refused(f"repeated {', '.join(keys)}")
    return df


def numeric_columns(df: DataFrame, *but: str) -> list[str]:
    """Columns of a numeric type, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def refuse_leaking_columns(names: list[str], allowed: tuple[str, ...] = ("generation_forecast",)) -> None:
    """Only forecasts may be features; actual values and consumption are known too late."""
    leaking = [n for n in names if n not in allowed and re.search("actual|consumption|scheduled", n)]
    if leaking:
        raise Refused(f"columns known only after the fact: {', '.join(leaking)}")
