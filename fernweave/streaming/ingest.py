"""Incremental ingest, upsert and rate windows with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fernweave.functions.arrays import explode_array
from fernweave.operators.sets import keep_last
from fernweave.sinks.buckets import BUCKETS, is_bucketed, read_buckets, upsert_buckets
from fernweave.sinks.snapshots import upsert
from fernweave.session import matching_names, path_exists
from fernweave.sources.snapshots import Commit, read_snapshot

#: State on local disks, so that it need not fit into the executors' heaps.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True).close()


def _claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Mark a folder as filled from this checkpoint; raise if another one has filled it.

    Batch numbers start again with a new checkpoint, so its batches would replace stored ones.
    The marks are looked at again after one's own is set, so of two that start at once not both
    go on.
    """
    mark = "_checkpoint-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    if mark not in (marks := matching_names(spark, f"{path}/_checkpoint-*")):
        if not marks:
            _mark(spark, f"{path}/{mark}")
        marks = matching_names(spark, f"{path}/_checkpoint-*")
    if marks != [mark]:
        raise ValueError(f"{path} was filled from another checkpoint; use that one, or another folder")


def ingest(stream: DataFrame, path: str, checkpoint: str, dataset_id: int) -> StreamingQuery:
    """Append everything that is there now, stamped with its batch.

    Each batch replaces its own folder, so a batch that is retried after a lost executor or a
    restart is not stored twice.  Batches are numbered by the checkpoint; a folder filled from
    another checkpoint is refused.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumns({"_dataset_id": F.lit(dataset_id), "_extraction_timestamp": F.current_timestamp()})
        stamped.write.mode("overwrite").parquet(f"{path}/_batch_id={batch_id}")

    _claim(stream.sparkSession, path, checkpoint)
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started meanwhile keep their state in RocksDB, whose memory is bounded on each executor."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def store_updates(results: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Store each batch's rows under the batch's own folder, for :func:`read_updates`."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch_id={batch_id}")

    _claim(results.sparkSession, path, checkpoint)
    writer = results.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    with _state_on_disk(results.sparkSession):  # a query keeps what was set when it began
        return writer.trigger(availableNow=True).start()


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], sequence: list[str]) -> StreamingQuery:
    """Upsert by key: the last row in sequence wins, whichever batch brought it.

    A batch writes its own rows only, never the whole table, and replaces its own folder
    when it is retried.  :func:`read_updates` gives the current rows and
    :func:`fold_updates` merges them into a versioned table from time to time.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch, keys, sequence).write.mode("overwrite").parquet(f"{path}/_batch_id={batch_id}")

    _claim(stream.sparkSession, path, checkpoint)
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: list[str], sequence: list[str] = ()) -> DataFrame:
    """The last stored row of every key: by sequence, then by batch (a running maximum per key)."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "_batch_id")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*sequence, "_batch_id")).alias("_l"))
    return latest.select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])


def fold_updates(spark: SparkSession, path: str, table: str, keys: list[str], sequence: list[str] = ()) -> Commit:
    """Merge everything stored so far into a versioned table; of two rows of a key the later in sequence stays."""
    fresh = read_updates(spark, path, keys, sequence)
    if sequence and path_exists(spark, f"{table}/_commits"):
        fresh = keep_last(fresh.unionByName(read_snapshot(spark, table), allowMissingColumns=True), keys, list(sequence))
    return upsert(fresh, table, keys)


def new_batches(spark: SparkSession, path: str) -> list[int]:
    """Finished batches of :func:`stream_upsert` that :func:`fold_new_batches` has not merged yet."""
    folded = max((int(n) for n in matching_names(spark, f"{path}/_folded/*")), default=-1)
    done = {n for n in matching_names(spark, f"{path}/_batch_id=*") if path_exists(spark, f"{path}/{n}/_SUCCESS")}
    return sorted(b for b in (int(n.split("=")[1]) for n in done) if b > folded)


def _latest_of(spark: SparkSession, path: str, batches: list[int], keys: list[str], sequence: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/_batch_id={b}" for b in batches])
    values = [c for c in rows.columns if c not in (*keys, "_batch_id")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*sequence, "_batch_id")).alias("_l"))
    return latest.select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])


def fold_new_batches(spark: SparkSession, path: str, table: str, keys: list[str], sequence: list[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Merge the batches that came since the last fold into a bucketed table; returns their numbers.

    Only these batches are read and only the buckets of their keys rewritten.  A fold that
    dies is done again with the next one, to the same effect: rows are ordered by
    ``sequence``, without it the later batch wins.  Merged batches are marked, not removed.
    """
    batches = new_batches(spark, path)
    if batches:
        upsert_buckets(_latest_of(spark, path, batches, keys, sequence), table, keys, list(sequence) or None, buckets)
        _mark(spark, f"{path}/_folded/{batches[-1]}")
    return batches


def read_current(spark: SparkSession, path: str, table: str, keys: list[str], sequence: list[str] = ()) -> DataFrame:
    """The last row of every key: the bucketed table, and over it the batches not merged yet."""
    batches = new_batches(spark, path)
    if not is_bucketed(spark, table):
        return _latest_of(spark, path, batches, keys, sequence)
    held = read_buckets(spark, table)
    if not batches:
        return held
    fresh = _latest_of(spark, path, batches, keys, sequence).withColumn("_new", F.lit(1))
    both = fresh.unionByName(held.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return keep_last(both, keys, [*sequence, "_new"]).drop("_new")


def rate_windows(
    log: DataFrame, who: str, at: str, window: str = "1 hour", slide: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """Requests per requester and sliding window; on a stream, rows later than the watermark are dropped.

    Works on a stream or a plain frame.  Counts are combined before the shuffle, so a
    busy requester costs one row per window and task.  A stream's rows are first spread over
    all tasks, as few large files would be copied to windows by few tasks; a plain frame is first counted per
    slide, and only those counts are copied to the windows they fall in; the window must
    then be a whole number of slides.
    """
    timed = log.withColumn(at, F.col(at).cast("timestamp"))
    if not log.isStreaming:
        return _windows_from_slides(timed, who, at, window, slide)
    timed = timed.repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = timed.withWatermark(at, lateness).groupBy(F.window(at, window, slide), who).agg(F.count("*").alias("requests"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), who, "requests"
    )


def _windows_from_slides(timed: DataFrame, who: str, at: str, window: str, slide: str) -> DataFrame:
    slides = timed.groupBy(F.window(at, slide).alias("_slide"), who).agg(F.count("*").alias("_n"))
    length, step = F.expr(f"INTERVAL {window}"), F.expr(f"INTERVAL {slide}")
    first = F.col("_slide.end") - length
    starts = explode_array(slides, [who, "_n"], F.sequence(first, F.col("_slide.start"), step), "window_start")
    counted = starts.groupBy("window_start", who).agg(F.sum("_n").alias("requests"))
    return counted.select("window_start", (F.col("window_start") + length).alias("window_end"), who, "requests")
