"""Tables and artifact documents."""

from __future__ import annotations

import hashlib
import json
import math
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..guards import Refused
from ..operators.scoring import validate_predictions
from .raw_store import publish


def write_predictions(df: DataFrame, table: str, targets: list[str], *, mode: str = "errorifexists", format: str = "parquet", rows: int | None = 168) -> DataFrame:
    """Validates, writes, reads again and validates what was read."""
    validate_predictions(df, targets, rows=rows).write.mode(mode).format(format).saveAsTable(table)
    return validate_predictions(df.sparkSession.table(table), targets, rows=rows)


def append_result(spark: SparkSession, table: str, group: str, result: float, identifier: str, timestamp) -> None:
    spark.createDataFrame([(group, result, identifier, timestamp)], "group_name string, result double, identifier string, timestamp timestamp").write.mode("append").saveAsTable(table)


def cooldown_over(spark: SparkSession, table: str, group: str, now, seconds: float) -> bool:
    """Whether the group's last result is old enough."""
    if not spark.catalog.tableExists(table):
        return True
    last = spark.table(table).where(F.col("group_name") == group).agg(F.max("timestamp").alias("t")).first()["t"]
    return last is None or (now - last).total_seconds() >= seconds


def write_report(df: DataFrame, path: str, format: str = "json", by: tuple[str, ...] = ()) -> None:
    """One file for a small report, folders by column for predictions."""
    out = df if by else df.coalesce(1)
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).format(format).save(path)


def _strict(document):
    if isinstance(document, float) and not math.isfinite(document):
        raise Refused("no JSON number")
    if isinstance(document, dict):
        return {str(k): _strict(v) for k, v in document.items()}
    return [_strict(v) for v in document] if isinstance(document, (list, tuple)) else document


def canonical(document) -> bytes:
    """Sorted keys, no spaces, no NaN: the same bytes for equal documents."""
    return json.dumps(_strict(document), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def content_hash(document) -> str:
    return hashlib.sha256(canonical(document)).hexdigest()


def read_document(path: str):
    def refuse(text):
        raise Refused(f"{path}: {text} is no JSON number")

    try:
        with open(path, "rb") as f:
            return json.loads(f.read(), parse_constant=refuse)
    except (OSError, json.JSONDecodeError) as error:
        raise Refused(f"{path}: {error}") from error


#: Documents of an artifact bundle.
BUNDLE = ("forecast.json", "histogram.json", "scoreboard.json", "provenance.json", "run_manifest.json")


def write_bundle(folder: str, documents: dict, repo: str | None = None) -> dict:
    """Writes the documents and a manifest with the hash of each; returns the manifest."""
    hashes = {}
    for name, document in sorted(documents.items()):
        publish(f"{folder}/{name}", canonical(document))
        hashes[name] = content_hash(document)
    manifest = {"schema_version": 1, "artifacts": hashes, "git_commit": git_commit(repo) if repo else None, "forecast_id": documents.get("forecast.json", {}).get("forecast_id")}
    manifest["manifest_hash"] = content_hash(manifest)
    publish(f"{folder}/run_manifest.json", canonical(manifest))
    return manifest


def load_bundle(folder: str) -> dict:
    """Documents of a bundle; a changed document, hash or identity is refused."""
    docs = {n: read_document(f"{folder}/{n}") for n in BUNDLE if os.path.exists(f"{folder}/{n}")}
    missing = set(BUNDLE) - set(docs)
    if missing:
        raise Refused(f"missing {sorted(missing)}")
    manifest = dict(docs["run_manifest.json"])
    own = manifest.pop("manifest_hash", None)
    if content_hash(manifest) != own:
        raise Refused("the manifest has changed")
    for name, digest in manifest["artifacts"].items():
        if content_hash(docs[name]) != digest:
            raise Refused(f"{name} has changed")
    ids = {docs[n].get("forecast_id") for n in ("forecast.json", "histogram.json") if isinstance(docs[n], dict)}
    if len(ids) > 1:
        raise Refused("documents of different forecasts")
    return docs


def git_commit(repo: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None
