"""Size-tiered compaction of immutable shards under versioned manifests.

Arrivals are appended as small Parquet shards.  Shards of like size form a tier; a tier that has collected ``fan_in``
shards is merged into files of the target size, tier by tier, so each row is rewritten a number of times that grows
with the logarithm of the store.  Every change writes new files first and then commits one manifest, by renaming it
to the next version: a rename that finds the version taken fails, and the commit is done again on what it found.
Readers see the files of one manifest, whole.  Rows move in DataFrame operations only; the driver handles file names.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 64 << 20
#: Sizes below this are one tier.
LEAST_BYTES = 256 << 10
FAN_IN = 4


class ShardStore:
    """A folder with ``data/<run>/`` files and ``manifests/<version>.json``."""

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, least_bytes: int = LEAST_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.target, self.least, self.fan_in = spark, root.rstrip("/"), target_bytes, least_bytes, fan_in
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        keep = jvm.org.apache.hadoop.fs.Options.Rename
        self._no_clobber = spark.sparkContext._gateway.new_array(keep, 1)
        self._no_clobber[0] = getattr(keep, "NONE")
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # -- manifests

    def version(self) -> int:
        """The newest version; 0 for a store without one."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:08d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Commits a manifest as its version; False if another writer was first."""
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            self._files.rename(draft, self._path(f"{self.root}/manifests/{manifest['version']:08d}.json"), self._no_clobber)
            return True
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def commit(self, add: list[dict], remove: list[str] = (), schema: str | None = None) -> int:
        """Adds and removes shards in one new version.  Fails if a shard to remove has gone meanwhile."""
        while True:
            now = self.manifest()
            paths = {s["path"] for s in now["shards"]}
            if not paths >= set(remove):
                raise RuntimeError("another writer has replaced these shards")
            shards = [s for s in now["shards"] if s["path"] not in set(remove)] + add
            if self._publish({"version": now["version"] + 1, "schema": now["schema"] or schema, "shards": shards}):
                return now["version"] + 1

    # -- data

    def _written(self, df: DataFrame) -> list[dict]:
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(run)
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(run))]
        return [{"path": f"{run}/{name}", "bytes": size} for name, size in sorted(files) if name.startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """One arrival: each of its partitions becomes a small shard."""
        return self.commit(self._written(df), schema=df.schema.json())

    def tier(self, size: int) -> int:
        return 0 if size <= self.least else 1 + int(math.log(size / self.least, self.fan_in))

    def _merges(self) -> list[list[dict]]:
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [sorted(t, key=lambda s: (s["bytes"], s["path"])) for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]

    def compact(self) -> int:
        """Merges full tiers until none is left; returns the number of merges."""
        done = 0
        while runs := self._merges():
            run = runs[0]
            files = max(1, min(len(run) // 2, math.ceil(sum(s["bytes"] for s in run) / self.target)))
            merged = self._load([s["path"] for s in run], self.manifest()["schema"]).coalesce(files)
            self.commit(self._written(merged), [s["path"] for s in run])
            done += 1
        return done

    def _load(self, paths: list[str], schema: str | None) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version, by default the newest."""
        manifest = self.manifest(version)
        return self._load([s["path"] for s in manifest["shards"]], manifest["schema"])

    def vacuum(self) -> int:
        """Deletes files that the newest manifest does not name; older versions can then not be read."""
        kept, gone = {s["path"].split("/data/")[1] for s in self.manifest()["shards"]}, 0
        for run in self._fs.listStatus(self._path(f"{self.root}/data")):
            for f in self._fs.listStatus(run.getPath()):
                name = f"{run.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().startswith("part-") and name not in kept:
                    self._fs.delete(f.getPath(), False)
                    gone += 1
        return gone


def ingest(docs: DataFrame, root: str, arrival: Column, arrivals: int, **sizes: int) -> ShardStore:
    """Appends ``docs`` as ``arrivals`` arrivals (``arrival``: 0 to arrivals - 1), compacting after each.

    Rows whose arrival is null come with the first.  All columns are kept as they are: nulls, empty and long texts,
    repeated rows and extra columns; an empty table commits an arrival without rows.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    for k in range(arrivals):
        store.append(docs.where(F.coalesce(arrival, F.lit(0)) == k))
        store.compact()
    return store
