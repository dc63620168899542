"""Streams over files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunks import PROVIDER, ROCKSDB

_OWN: set[str] = set()
#: Of files, compressed, that a micro-batch reads at most, if one file isn't more.
BATCH_BYTES = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's folder in there. The driver deletes it when it ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(hadoop)
        store.deleteOnExit(hadoop)
        _OWN.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete the application's folder now: for long sessions, when no table in it is needed any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dealt(rows: DataFrame, files: int) -> DataFrame:
    """A scan of fewer splits than that is dealt over all cores, and its documents over files. Others stay as they are: a document's rows
    come one after another then, and no more than the splits' number is written at once anyhow."""
    plan = rows._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= files:  # a shuffle would be run to count
        return rows
    return rows.repartition(max(files, rows.sparkSession.sparkContext.defaultParallelism))


def run_available(rows: DataFrame, plan: Callable[[DataFrame], DataFrame], files: int = 4) -> DataFrame:
    """rows written as files, read as a stream, BATCH_BYTES or half of them at a time, through plan, until all is read; what came out, as
    a table. Recovers from lost executors as any stream does; state is in RocksDB for the time of the run, as are the files read."""
    spark = rows.sparkSession
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    dealt(rows, files).write.parquet(f"{base}/in")
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/in")
    store = written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = min(BATCH_BYTES, max(1, store.getContentSummary(written).getLength() // 2))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        out = plan(spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", size).parquet(f"{base}/in"))
        schema = out.schema
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
        store.delete(written, True)
    return spark.read.schema(schema).parquet(f"{base}/out")
