"""Readers: CSV, JSON and Parquet evidence, workbooks, statement results; and column mapping."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..guards import Refused, numeric_columns

#: Formats by file ending.
FORMATS = {"csv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet"}


def detect_format(path: str, format: str | None = None) -> str:
    name = (format or path.rpartition(".")[2]).lower()
    if name not in FORMATS:
        raise Refused(f"unknown format {name!r}")
    return FORMATS[name]


def load_rows(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Rows of a file or folder. CSV columns stay text; JSON may be lines, a list, or a list under records or data."""
    kind = detect_format(path, format)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    lines = (format or path.rpartition(".")[2]).lower() in ("ndjson", "jsonl")
    rows = spark.read.option("multiLine", not lines).json(path)
    for field in ("records", "data"):
        if rows.columns == [field] or (field in rows.columns and rows.schema[field].dataType.typeName() == "array"):
            return rows.select(F.explode(field).alias("r")).select("r.*")
    if "_corrupt_record" in rows.columns:
        raise Refused("rows are no JSON objects")
    return rows


def mapped(rows: DataFrame, columns: dict[str, str], constants: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from provider columns; an empty text counts as null, then the default applies."""
    constants, defaults = constants or {}, defaults or {}
    clash = set(columns) & set(constants)
    if clash or len(set(columns.values())) != len(columns):
        raise Refused(f"ambiguous mapping: {sorted(clash) or 'one column for two fields'}")

    def value(field: str, source: str) -> Column:
        col = F.col(f"`{source}`")
        own = F.when(F.trim(col.cast("string")) == "", None).otherwise(col)
        return (F.coalesce(own, F.lit(defaults[field])) if field in defaults else own).alias(field)

    return rows.select(*(value(f, s) for f, s in columns.items()), *(F.lit(v).alias(f) for f, v in constants.items()))


def selector(column: Column, pattern: str) -> Column:
    """A trailing * matches a prefix, else the whole."""
    return column.startswith(pattern[:-1]) if pattern.endswith("*") else column == pattern


def source_contracts(rows: DataFrame) -> DataFrame:
    """Country, domain and units of each source; a source with several countries or domains is refused."""
    got = rows.groupBy("source_id").agg(F.min("country").alias("country"), F.min("domain").alias("domain"), F.sort_array(F.collect_set("unit")).alias("units"), F.count_distinct("country").alias("c"), F.count_distinct("domain").alias("d"))
    if not got.where("c > 1 or d > 1").isEmpty():
        raise Refused("a source changes its country or domain")
    return got.drop("c", "d")


def table_range(spark: SparkSession, table: str, time: str, start: str, end: str, zone: str | None = None) -> DataFrame:
    """Half-open range of a table, numbers as doubles: both the range and the columns reach the scan.

    ``zone``: the bounds are UTC and the column holds that zone's wall time; it is given back in UTC.  The bounds are
    moved, not the column, so the scan still prunes by them.
    """
    rows = spark.table(table)
    names = numeric_columns(rows, time)
    kind = rows.schema[time].dataType
    bound = lambda text: (F.from_utc_timestamp(F.lit(text).cast("timestamp"), zone) if zone else F.lit(text)).cast(kind)
    rows = rows.where((F.col(time) >= bound(start)) & (F.col(time) < bound(end)))
    if zone:
        rows = rows.withColumn(time, F.to_utc_timestamp(F.col(time), zone).cast(kind))
    return rows.select(time, *(F.col(n).cast("double").alias(n) for n in names))


def table_family(spark: SparkSession, database: str, prefix: str, time: str, column: str) -> DataFrame:
    """Hourly means of one allowed column of every table with a prefix, one aggregation each, side by side."""
    from ..guards import refuse_leaking_columns

    refuse_leaking_columns([column])
    names = sorted(r["tableName"] for r in spark.sql(f"show tables in {database}").collect() if r["tableName"].startswith(prefix))
    parts = [spark.table(f"{database}.{n}").groupBy(F.date_trunc("hour", F.col(time)).alias("hour")).agg(F.avg(F.col(column).cast("double")).alias("value")).withColumn("table_name", F.lit(n)) for n in names]
    if not parts:
        raise Refused(f"no table {prefix}*")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def statement_rows(spark: SparkSession, path: str, *chunks: str) -> DataFrame:
    """Rows of a statement's JSON result: manifest columns by ordinal, data arrays of the result and of further chunks."""
    head = spark.read.option("multiLine", True).json(path)
    names = [r["name"] for r in head.select(F.explode("manifest.schema.columns").alias("c")).select("c.name", "c.position").orderBy("position").collect()]
    data = head.select(F.explode("result.data_array").alias("a"))
    for c in chunks:
        data = data.unionByName(spark.read.option("multiLine", True).json(c).select(F.explode("data_array").alias("a")))
    return data.select(*(F.get("a", F.lit(i)).alias(n) for i, n in enumerate(names)))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


# -- workbooks: a zip of XML parts, read one row at a time

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind as the part is parsed; each is emptied once it has been used."""
    with book.open(part) as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag == tag:
                yield element
                element.clear()


def _written(element: ElementTree.Element | None) -> str:
    """The text of an element's runs."""
    return "" if element is None else "".join(t.text or "" for t in element.iter(_SHEET + "t"))


def column_number(reference: str) -> int:
    """The column of a cell reference, A as 0: letters are digits from 1 to 26."""
    letters = reference.rstrip("0123456789")
    return sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1


def sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds a sheet: the first, or that of a name."""
    if sheet is None:
        return "xl/worksheets/sheet1.xml"
    ids = {e.get("name"): e.get(_RELATION) for e in _elements(book, "xl/workbook.xml", _SHEET + "sheet")}
    if sheet not in ids:
        raise Refused(f"no sheet {sheet!r}")
    package = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
    target = next(e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", package) if e.get("Id") == ids[sheet])
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """Rows of texts up to their last cell; cells that the file leaves out are empty texts.

    Only the table of shared texts is held, never a sheet.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        texts = [_written(e) for e in _elements(book, "xl/sharedStrings.xml", _SHEET + "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in _elements(book, sheet_part(book, sheet), _SHEET + "row"):
            own: dict[int, str] = {}
            for cell in row.iterfind(_SHEET + "c"):
                place = column_number(cell.get("r")) if cell.get("r") else len(own)
                value = cell.findtext(_SHEET + "v") or ""
                kind = cell.get("t")
                own[place] = texts[int(value)] if kind == "s" and value else _written(cell.find(_SHEET + "is")) if kind == "inlineStr" else value
            yield [own.get(k, "") for k in range(max(own, default=-1) + 1)]


def workbooks(spark: SparkSession, path: str, sheet: str | None = None, batch: int = 2000) -> DataFrame:
    """path, row and cells of every workbook below a path, parsed where the files are read, some rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = enumerate(sheet_rows(bytes(data), sheet))
                while some := list(islice(rows, batch)):
                    yield pd.DataFrame({"path": p, "row": [k for k, _ in some], "cells": [c for _, c in some]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")


def price_series(cells: DataFrame, feature: str) -> DataFrame:
    """feature, ts, value and known_at of a two-header sheet: codes in the first row, serial dates in the first column.

    ``cells`` has row and cells.  Values that fall on one hour are averaged and known when the last of them is.
    """
    from ..functions.scalars import day_ahead_known_at, delivery_hour, excel_time, number

    codes = F.broadcast(cells.where("row = 0").select(F.posexplode("cells").alias("at", "code")))  # one row of a sheet
    body = cells.where("row >= 2").select(F.get("cells", F.lit(0)).alias("date"), F.posexplode("cells").alias("at", "text")).where("at > 0")
    rows = body.join(codes, "at")
    hour, again = delivery_hour(F.col("code"))
    wall = excel_time(number(F.col("date"))) + F.make_dt_interval(F.lit(0), hour - 1)
    ts = F.to_utc_timestamp(wall, "Europe/Paris") + F.make_dt_interval(F.lit(0), F.when(again, 1).otherwise(0))
    got = rows.select(ts.alias("ts"), number(F.col("text")).alias("value")).where("ts is not null and value is not null")
    return got.withColumn("known_at", day_ahead_known_at(F.col("ts"))).groupBy("ts").agg(F.avg("value").alias("value"), F.max("known_at").alias("known_at")).select(F.lit(feature).alias("feature"), "ts", "value", "known_at")


def revision_activity(rows: DataFrame, time: str, delta: str | None = None) -> DataFrame:
    """Per publication time: the sum of absolute changes, or the number of messages."""
    from ..functions.scalars import number

    n = F.sum(F.abs(F.coalesce(number(F.col(delta)), F.lit(0.0)))) if delta else F.count(F.lit(1)).cast("double")
    return rows.groupBy(F.col(time).alias("known_at")).agg(n.alias("value"))


def publication_rows(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a CSV as texts, without a byte order mark; bytes that are no UTF-8 become the replacement sign."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.select(*(F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in rows.columns))


def daily_unavailability(rows: DataFrame, time: str = "issue_time_utc", value: str = "total_unavailable_mw_h0", order: str | None = None) -> DataFrame:
    """known_at and value of daily rows; of several rows of one time the last in the file's order wins."""
    from ..functions.scalars import number, utc_time

    place = F.col(order) if order else F.monotonically_increasing_id()
    own = rows.select(F.coalesce(utc_time(F.col(time)), F.try_to_timestamp(F.col(time))).alias("known_at"), number(F.col(value)).alias("value"), place.alias("_at")).where("known_at is not null and value is not null")
    return own.groupBy("known_at").agg(F.max_by("value", "_at").alias("value"))


def resolve_root(given: str | None, variable: str, *defaults: str) -> str | None:
    """The folder given, else that of an environment variable, else the first default that exists."""
    for path in (given, os.environ.get(variable), *defaults):
        if path and (path == given or os.path.isdir(path)):
            return path
    return None


def family(spark: SparkSession, files: dict[str, str], readers: dict) -> tuple[DataFrame | None, list[dict]]:
    """One long table of feature, known_at and value, and what became of each file: selected, or rejected and why."""
    out, inventory = None, []
    for name, path in sorted(files.items()):
        try:
            if first_existing(spark, path) is None:
                raise Refused("no such file")
            rows = readers[name](spark, path).select(F.lit(name).alias("feature"), "known_at", "value")
            out = rows if out is None else out.unionByName(rows)
            inventory.append({"feature": name, "path": path, "status": "selected", "reason": ""})
        except (Refused, KeyError) as error:
            inventory.append({"feature": name, "path": path, "status": "rejected", "reason": str(error)})
    return out, inventory


#: Domains, units and levels of the synthetic sources.
SYNTHETIC = (("load", "MW", 900.0), ("net_position", "MW", 100.0), ("nuclear", "MW", 400.0), ("price", "EUR/MWh", 60.0), ("solar", "MW", 200.0), ("wind", "MW", 150.0))


def synthetic(spark: SparkSession, first: str, hours: int, seed: int = 0) -> DataFrame:
    """Hourly revisions of six domains that depend on the seed alone, with gaps, late receipts, revisions and nulls."""
    sources = F.explode(F.array(*(F.struct(F.lit(d).alias("source_id"), F.lit(u).alias("unit"), F.lit(v).alias("level")) for d, u, v in SYNTHETIC)))
    rows = spark.range(hours).select("id", sources.alias("s")).select("id", "s.*")
    noise = lambda k: F.pmod(F.xxhash64("id", "source_id", F.lit(seed), F.lit(k)), F.lit(10_000)) / 10_000
    time = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
    rows = rows.where(noise(1) >= 0.02).withColumn("revision_sequence", F.explode(F.when(noise(2) < 0.05, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = F.when(noise(3) < 0.1, 6).otherwise(1) + 12 * F.col("revision_sequence")
    value = F.col("level") * (1 + 0.2 * F.sin(2 * F.pi() * F.col("id") / 24) + 0.05 * (noise(4) - 0.5) + 0.01 * F.col("revision_sequence"))
    return rows.select(
        "source_id", F.concat_ws("-", "source_id", F.col("id").cast("string")).alias("source_record_id"), "revision_sequence", "unit", time.alias("event_time"), time.alias("valid_time"),
        (time + F.make_dt_interval(F.lit(0), late.cast("int"))).alias("known_at"), F.when(noise(5) >= 0.03, value).alias("value"),
    )
