"""Content-addressed evidence: blobs by digest, receipts beside them, files written once."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..guards import Refused


def publish(path: str, payload: bytes) -> bool:
    """Writes a file whole or not at all; False if it is there with the same bytes, refused with others."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(draft, "xb") as f:
        f.write(payload)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, path)
        os.chmod(path, 0o444)
        return True
    except FileExistsError:
        with open(path, "rb") as f:
            if f.read() != payload:
                raise Refused(f"{path} holds other content") from None
        return False
    finally:
        os.unlink(draft)


@dataclass(frozen=True)
class Receipt:
    """What was received, when, and as which source."""

    receipt_id: str
    sha256: str
    source_id: str
    first_received_at: str
    schema_version: int = 1
    notes: dict = field(default_factory=dict)


class RawStore:
    """``raw/<digest>`` and ``manifests/<receipt>.json`` below a folder."""

    def __init__(self, root: str) -> None:
        self.root = root

    def put(self, payload: bytes, source_id: str, received_at: datetime, **notes: str) -> Receipt:
        if received_at.tzinfo is None:
            raise Refused("the receipt clock has no zone")
        digest = hashlib.sha256(payload).hexdigest()
        publish(f"{self.root}/raw/{digest}", payload)
        receipt = Receipt(uuid.uuid4().hex, digest, source_id, received_at.astimezone(timezone.utc).isoformat(), notes=notes)
        publish(f"{self.root}/manifests/{receipt.receipt_id}.json", json.dumps(asdict(receipt), sort_keys=True).encode())
        return receipt

    def retrieve(self, fetch: Callable[[], bytes], source_id: str, clock: Callable[[], datetime], **notes: str) -> Receipt:
        """The clock is read after the fetch has completed."""
        payload = fetch()
        return self.put(payload, source_id, clock(), **notes)

    def read(self, digest: str) -> bytes:
        with open(f"{self.root}/raw/{digest}", "rb") as f:
            payload = f.read()
        if hashlib.sha256(payload).hexdigest() != digest:
            raise Refused(f"{digest} has changed")
        return payload

    def manifests(self, spark: SparkSession) -> DataFrame:
        """Receipts by time and id."""
        return spark.read.json(f"{self.root}/manifests").orderBy("first_received_at", "receipt_id")

    def blobs(self, spark: SparkSession) -> DataFrame:
        """path, content and digest of every blob, hashed where it is read; a changed blob has intact false."""
        rows = spark.read.format("binaryFile").load(f"{self.root}/raw").select("path", "content", F.sha2("content", 256).alias("sha256"))
        return rows.withColumn("intact", F.regexp_extract("path", "([0-9a-f]{64})$", 1) == F.col("sha256"))


def ingest(spark: SparkSession, store: RawStore, schema: str, units: dict[str, list[str]]) -> DataFrame:
    """Observations parsed from intact JSON blobs, each with its digest; a changed blob or a foreign unit is refused."""
    blobs = store.blobs(spark)
    if not blobs.where("not intact").isEmpty():
        raise Refused("a blob has changed since it was received")
    receipts = store.manifests(spark).groupBy("sha256").agg(F.min_by("source_id", "first_received_at").alias("source_id"), F.min("first_received_at").alias("first_received_at"))
    rows = blobs.join(receipts, "sha256").select("sha256", "source_id", F.try_to_timestamp("first_received_at").alias("first_received_at"), F.from_json(F.col("content").cast("string"), schema).alias("o")).select("source_id", "first_received_at", F.col("sha256").alias("raw_sha256"), "o.*")
    known = F.create_map(*(x for s, u in units.items() for x in (F.lit(s), F.array(*map(F.lit, u)))))
    bad = rows.where(~F.coalesce(F.array_contains(known[F.col("source_id")], F.col("unit")), F.lit(False)))
    if not bad.isEmpty():
        raise Refused("a source without contract, or a unit that its contract does not name")
    return rows
