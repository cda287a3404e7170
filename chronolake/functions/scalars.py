"""Scalar functions over columns: tolerant parsing, local time, quantiles of arrays, rounding."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no number.
NO_NUMBER = ("", "nan", "null", "none", "n/a", "na", "-")


def number(text: Column) -> Column:
    """A finite double, or null. Thousands separators are ignored."""
    plain = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    value = F.when(~F.lower(plain).isin(*NO_NUMBER), plain).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def utc_time(text: Column) -> Column:
    """An instant from ISO text with an offset; text without one, or that is no time, gives null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def offset_of(text: Column) -> Column:
    """The offset part of ISO text, Z as +00:00, null without one."""
    found = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    return F.when(found == "Z", "+00:00").when(found != "", found)


def duration_seconds(value: Column) -> Column:
    """Positive seconds, else null."""
    s = value.try_cast("double")
    return F.when(s > 0, s)


def excel_time(serial: Column) -> Column:
    """A spreadsheet's serial date."""
    return F.timestamp_micros((F.unix_micros(F.lit("1899-12-30 00:00:00").cast("timestamp")) + F.rint(serial * 86_400_000_000)).cast("bigint"))


def local_to_utc(wall: Column, zone: str) -> Column:
    """A wall time as an instant; a wall time that the zone skips or repeats raises."""
    instant = F.to_utc_timestamp(wall, zone)
    skipped = F.from_utc_timestamp(instant, zone) != wall.cast("timestamp")
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(instant + hour, zone) == wall.cast("timestamp")) | (F.from_utc_timestamp(instant - hour, zone) == wall.cast("timestamp"))
    return F.when(skipped, F.raise_error(F.concat(F.lit("skipped local time "), wall.cast("string")))).when(twice, F.raise_error(F.concat(F.lit("repeated local time "), wall.cast("string")))).otherwise(instant)


def delivery_hour(code: Column) -> tuple[Column, Column]:
    """Hour of an instrument code and whether it is the repeated one: ``…PNX07``, ``…PNX03B``."""
    pattern = r"(?:PNX|GMEIT|GMEDEMIT)(\d{2})(B?)$"
    return F.regexp_extract(code, pattern, 1).try_cast("int"), F.regexp_extract(code, pattern, 2) == "B"


def day_ahead_known_at(delivery: Column, zone: str = "Europe/Paris") -> Column:
    """Noon, local time, of the day before delivery."""
    day = F.date_sub(F.to_date(F.from_utc_timestamp(delivery, zone)), 1)
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 12 hours"), zone)


def earliest_known_at(*clocks: Column) -> Column:
    """The latest of the clocks that are set."""
    return F.greatest(*clocks)


def array_quantile(values: Column, p: float) -> Column:
    """Linear quantile of an array; null for an empty one."""
    s = F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def nearest_interval(values: Column, low: int = 30, high: int = 270) -> tuple[Column, Column]:
    """Elements at two places of the sorted array."""
    s = F.sort_array(values)
    return F.get(s, F.lit(low)), F.get(s, F.lit(high))


def even_round(value: Column) -> Column:
    """Halves to the even integer."""
    return F.rint(value).cast("int")


def percent(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * score))


def normal_points(n: int = 19) -> list[tuple[float, float]]:
    """Probabilities and normal quantiles for a Q-Q plot."""
    return [(k / (n + 1), NormalDist().inv_cdf(k / (n + 1))) for k in range(1, n + 1)]


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def safe_name(name: str) -> str:
    return name.replace("-", "_").replace(" ", "_")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def identity_hash(*columns: Column) -> Column:
    """sha256 of the canonical JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
