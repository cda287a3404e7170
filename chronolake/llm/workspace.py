"""Shared working folders, written tables and Arrow batch limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: a Python worker holds one batch of whole texts at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    The setting is read from the session.  Where it is unset, a session on one machine gets a temporary folder, set
    once so that later calls share it; on a cluster executors could not share one, and that is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="chronolake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, at: str | None = None, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    at = at or shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def forget(spark: SparkSession, at: str) -> None:
    """Removes a folder made by this module."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
