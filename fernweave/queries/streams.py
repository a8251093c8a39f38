"""Incremental ingest, streaming upsert and rate windows, run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.queries.registry import Tables, query
from fernweave.sinks.buckets import read_buckets, upsert_buckets
from fernweave.sources.snapshots import read_snapshot
from fernweave.streaming import ingest, rates


def _arrivals(t: Tables, folder: str, files_per_trigger: int | None = 2) -> DataFrame:
    """The events as files to be picked up a few at a time, or all at once."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(6, "ts").write.parquet(folder)
    return ingest.file_stream(t.spark, folder, events.schema, files_per_trigger)


@query("SELECT event_id, ts, user_id, event_type, value, props, 4 AS _dataset_id FROM events")
def incremental_ingest(t: Tables) -> DataFrame:
    """Files appended in several stamped batches; each row arrives once."""
    path = t.scratch("ingested")
    ingest.ingest(_arrivals(t, t.scratch("arrivals")), path, t.scratch("checkpoint"), 4).awaitTermination()
    return t.spark.read.parquet(path).drop("_batch_id", "_extraction_timestamp")


_LATEST = "SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _updates(t: Tables, path: str) -> None:
    """The latest events of each batch by user, over several batches, the newest files first."""
    events, folder = t.events.withColumn("ts", F.col("ts").cast("timestamp")), t.scratch("arrivals")
    events.repartitionByRange(6, F.col("ts").desc()).write.parquet(folder)
    stream = ingest.file_stream(t.spark, folder, events.schema, 2)
    ingest.stream_upsert(stream, path, t.scratch("checkpoint"), ["user_id"], ["ts", "event_id"]).awaitTermination()


@query(_LATEST)
def streaming_upsert(t: Tables) -> DataFrame:
    """The latest event of every user over several batches, folded into a versioned table."""
    path, table = t.scratch("updates"), t.scratch("latest")
    _updates(t, path)
    ingest.fold_updates(t.spark, path, table, ["user_id"], ["ts", "event_id"])
    return read_snapshot(t.spark, table)


@query(_LATEST)
def streaming_fold(t: Tables) -> DataFrame:
    """The same folded into buckets, once with the first batches and once with those that came since."""
    path, table = t.scratch("updates"), t.scratch("latest-buckets")
    _updates(t, path)
    early = ingest._latest_of(t.spark, path, ingest.new_batches(t.spark, path)[:1], ["user_id"], ["ts", "event_id"])
    upsert_buckets(early, table, ["user_id"], ["ts", "event_id"], 8)
    ingest.fold_new_batches(t.spark, path, table, ["user_id"], ["ts", "event_id"])
    return read_buckets(t.spark, table)


_WINDOWS = """
WITH s AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '55 minutes', time_bucket(INTERVAL '5 minutes', ts), INTERVAL '5 minutes')) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, user_id, count(*) AS requests FROM s GROUP BY 1, 2, 3
"""


@query(_WINDOWS)
def rate_windows(t: Tables) -> DataFrame:
    """Requests per user and sliding hour."""
    return ingest.rate_windows(t.events, "user_id", "ts")


@query(_WINDOWS)
def streaming_rate_windows(t: Tables) -> DataFrame:
    """The same over a stream, stored as each window's count changes; the last count of a window stands."""
    path = t.scratch("windows")
    counts = ingest.rate_windows(_arrivals(t, t.scratch("arrivals"), None), "user_id", "ts")
    ingest.store_updates(counts, path, t.scratch("checkpoint")).awaitTermination()
    return ingest.read_updates(t.spark, path, ["window_start", "window_end", "user_id"])


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS second, event_type = 'purchase' AS held FROM events),
cut AS (SELECT (min(ms) + max(ms)) // 2 AS half, max(ms) - 600000 AS latest FROM e),
runs AS (SELECT e.*, held OR ms >= half AS after, max(CASE WHEN NOT held AND ms < half THEN ms END) OVER () - 600000 AS closed FROM e, cut),
marked AS (SELECT user_id, second, after AND (second + 1) * 1000 <= closed AS late FROM runs),
counts AS (SELECT user_id, second, late, count(*) AS requests FROM marked GROUP BY ALL)
SELECT user_id, second, requests, CASE WHEN NOT late THEN n END AS in_window, CASE WHEN NOT late THEN n >= 3 END AS exceeded, late
FROM (SELECT *, (sum(requests) OVER (PARTITION BY user_id, late ORDER BY second RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))::BIGINT AS n FROM counts)
WHERE late OR (second + 1) * 1000 <= (SELECT latest FROM cut)
""")
def streaming_trailing_rates(t: Tables) -> DataFrame:
    """Exact counts of each user's trailing day over a stream that is stopped half-way; purchases come with the second half, mostly too late."""
    events = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("held"))
    half = events.agg(F.expr("(min(unix_millis(ts)) + max(unix_millis(ts))) div 2")).scalar()
    after = F.col("held") | (F.unix_millis("ts") >= half)
    folder, path, checkpoint = t.scratch("arrivals"), t.scratch("rates"), t.scratch("checkpoint")
    for part in (~after, after):
        events.where(part).select("user_id", "ts").write.mode("append").parquet(folder)
        stream = ingest.file_stream(t.spark, folder, events.select("user_id", "ts").schema)
        found = rates.trailing_rates(stream, "user_id", "ts", 86400, 3)
        rates.store_trailing_rates(found, path, checkpoint).awaitTermination()
    return t.spark.read.parquet(path).drop("_batch_id")
