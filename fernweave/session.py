"""Session settings, the shared work folder and the clock."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024

#: Runtime settings every job relies on; each may be overridden by the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(128 * MB),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * MB),
    "spark.sql.files.maxPartitionBytes": str(128 * MB),
}


def build_session(app: str = "fernweave", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with the engine's runtime settings."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``.  Only a local session that
    names none gets a temporary folder; a cluster must name a shared one, since
    executors cannot see each other's local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written below the shared folder and read again, so that what follows plans from files."""
    folder = work_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


#: Rows and bytes of a batch of texts that is handed to a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of a few megabytes; workers hold several copies of a batch."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def clock(at: dt.datetime | None = None) -> Column:
    """The run's timestamp: the given instant, or the query's current time."""
    return F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def matching_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that a path pattern matches."""
    found = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().getName() for f in found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []]
