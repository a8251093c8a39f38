"""Writing versioned tables: replace, append, upsert, compact, expire."""

from __future__ import annotations

import datetime as dt
import json
import operator
import threading
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.operators.aggregates import snapshot_diff
from fernweave.operators.sets import keep_last
from fernweave.sources.files import list_files
from fernweave.sources.snapshots import COMMIT_SCHEMA, Commit, VersionNotFound, commits, read_snapshot, resolve_version

RETENTION = dt.timedelta(hours=168)

_claiming = threading.Lock()


def _claim_version(spark: SparkSession, path: str) -> int:
    """The next version number, taken by creating its file; a writer that finds it taken tries the next.

    File systems that create files atomically never give one number to two writers; on a local
    disk, which does not, writers of one process take turns.  Where a store lets two writers
    have one number, each still has its own folder, and the later commit is read.  A writer
    that dies leaves its number unused.
    """
    version = commits(spark, path).agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def taken(number: int) -> bool:
        try:
            return not files.createNewFile(hadoop.Path(f"{path}/_claims/{number}"))
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return True
            raise

    with _claiming:
        while taken(version):
            version += 1
    return version


def _log(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Append commit rows in one write, in a folder of its own so that writers do not share one while writing."""
    fields = T.StructType.fromDDL(COMMIT_SCHEMA)
    data = [tuple(row.get(f.name) for f in fields) for row in rows]
    spark.createDataFrame(data, fields).coalesce(1).write.parquet(f"{path}/_commits/{uuid.uuid4().hex}")


def sized(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Let adaptive execution cut the output into files of the advisory size (128 MB).

    Unlike ``coalesce`` this keeps the parallelism of the work before it; partitions of
    a hot column value are split.
    """
    return df.hint("rebalance", *columns) if columns else df.hint("rebalance")


def write_snapshot(
    df: DataFrame,
    path: str,
    operation: str = "overwrite",
    config: dict | None = None,
    partition_by: list[str] | None = None,
    at: dt.datetime | None = None,
    resize: bool = False,
) -> Commit:
    """Write a new version holding exactly these rows, with this schema.

    Rows are counted while they are written, not by a second job.  ``resize`` shuffles
    the output into files of the advisory size; without it a join's or aggregate's
    output is sized by adaptive execution anyway and a plain copy is not shuffled at all.
    Partitioned output is always resized, or every task would open a file per value.
    """
    spark = df.sparkSession
    version = _claim_version(spark, path)
    seen = Observation()
    out = sized(df, partition_by) if resize or partition_by else df
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    folder = f"_data/{version}-{uuid.uuid4().hex}"  # its own, should two writers ever get one number
    writer = out.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    stored = list_files(spark, f"{path}/{folder}", "*.parquet").agg(F.count("*").alias("n"), F.sum("length").alias("size")).first()
    files, size = stored["n"], stored["size"] or 0
    when = at or dt.datetime.now(dt.timezone.utc)
    rows = seen.get["rows"]
    commit = {"version": version, "committed_at": when, "operation": operation, "rows": rows, "files": files, "bytes": size, "folder": folder}
    _log(spark, path, [{**commit, "schema": df.schema.json(), "config": json.dumps(config) if config else None}])
    return Commit(version, rows, files, size)


def write_if_changed(df: DataFrame, path: str, key: str, fields: list[str], **kwargs) -> Commit | None:
    """A new version only when some row is new, changed or gone since the latest one."""
    spark = df.sparkSession
    try:
        current = read_snapshot(spark, path)
    except VersionNotFound:
        return write_snapshot(df, path, **kwargs)
    if snapshot_diff(current, df, key, fields).isEmpty():
        return None
    return write_snapshot(df, path, **kwargs)


def check_keys(df: DataFrame, keys: list[str], repeated: bool) -> None:
    """Raise on NULL keys and, if asked, on keys that occur twice; one job."""
    missing = F.coalesce(F.bool_or(reduce(operator.or_, [F.col(k).isNull() for k in keys])), F.lit(False)).alias("missing")
    if repeated:
        counted = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("_n"))
        row = counted.agg(missing, F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    else:
        row = df.agg(missing, F.lit(1).alias("most")).first()
    if row["missing"]:
        raise ValueError(f"NULL in the key {keys}")
    if repeated and row["most"] > 1:
        raise ValueError(f"repeated keys {keys} need a sequence")


def upsert(df: DataFrame, path: str, keys: list[str], sequence: list[str] | None = None, **kwargs) -> Commit:
    """Update rows with a known key, insert the others, keep the rest.

    A column the batch lacks keeps its value in updated rows and is NULL in inserted ones; a
    new column is added.  Several new rows of one key must be ordered by ``sequence``; the
    last wins.  NULL keys, and repeated keys without a sequence, raise.  A first write, or a
    table without the key columns, starts from the new rows alone.
    """
    spark = df.sparkSession
    check_keys(df, keys, repeated=sequence is None)
    fresh = keep_last(df, keys, sequence) if sequence else df
    try:
        current = read_snapshot(spark, path)
    except VersionNotFound:
        return write_snapshot(fresh, path, operation="create", **kwargs)
    if not set(keys) <= set(current.columns):
        return write_snapshot(fresh, path, operation="recreate", **kwargs)
    kept = current.join(fresh.select(*keys), keys, "left_anti")
    lacking = [c for c in current.columns if c not in fresh.columns]
    if lacking:
        fresh = fresh.join(current.select(*keys, *lacking), keys, "left")
    return write_snapshot(fresh.unionByName(kept, allowMissingColumns=True), path, operation="upsert", **kwargs)


def compact(spark: SparkSession, path: str, cluster_by: list[str] | None = None, min_rows: int = 10_000) -> Commit | None:
    """Rewrite the latest version in well-sized, optionally clustered files.

    Clustering also sorts on a hash of the row, so equal values may span partitions.
    """
    version = resolve_version(spark, path)
    rows = commits(spark, path).where((F.col("version") == version) & (F.col("operation") != "expire")).first()["rows"]
    if rows < min_rows:
        return None
    df = read_snapshot(spark, path, version)
    if not cluster_by:
        return write_snapshot(df, path, operation="compact", resize=True)
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = df.repartitionByRange(*[F.col(c) for c in cluster_by], spread).sortWithinPartitions(*cluster_by)
    return write_snapshot(ranged, path, operation="compact")


def expired_versions(log: DataFrame, now: dt.datetime, retention: dt.timedelta = RETENTION) -> DataFrame:
    """Commits older than the retention, never the newest."""
    newest = log.agg(F.max("version")).scalar()
    return log.where((F.col("committed_at") < F.lit(now - retention)) & (F.col("version") < newest))


def expire(spark: SparkSession, path: str, now: dt.datetime | None = None, retention: dt.timedelta = RETENTION) -> list[int]:
    """Retire old versions: readers refuse them from now on.

    Returns the retired versions, whose folders the store's own clean-up may remove.
    """
    now = now or dt.datetime.now(dt.timezone.utc)
    log = commits(spark, path)
    gone = {r["version"] for r in log.where("operation = 'expire'").select("version").collect()}
    old = expired_versions(log.where("operation != 'expire'"), now, retention).select("version").collect()
    versions = sorted({r["version"] for r in old} - gone)
    if versions:
        _log(spark, path, [{"version": version, "committed_at": now, "operation": "expire"} for version in versions])
    return versions
