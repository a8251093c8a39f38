"""Streams: retried batches, late rows, order of arrival."""

from __future__ import annotations

import time

import pytest

from fernweave.session import work_folder
from fernweave.sources.snapshots import read_snapshot
from fernweave.streaming import ingest

SCHEMA = "user int, ts timestamp, value string"


@pytest.fixture
def folders(spark):
    return {n: work_folder(spark, n) for n in ("in", "out", "check", "table")}


def arrive(spark, folder, data):
    rows = ", ".join(f"({u}, TIMESTAMP '{t}', '{v}')" for u, t, v in data)
    spark.sql(f"SELECT * FROM VALUES {rows} AS t(user, ts, value)").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in order of their time


def stream(spark, folder):
    from pyspark.sql.types import StructType

    return ingest.file_stream(spark, folder, StructType.fromDDL(SCHEMA), files_per_trigger=1)


def test_ingest_takes_each_file_once(spark, folders):
    for data in ([(1, "2024-01-01 00:00:00", "a")], [(2, "2024-01-01 00:00:00", "b")]):
        arrive(spark, folders["in"], data)
        ingest.ingest(stream(spark, folders["in"]), folders["out"], folders["check"], 7).awaitTermination()
    out = spark.read.parquet(folders["out"]).orderBy("user").collect()
    assert [(r["user"], r["_batch_id"], r["_dataset_id"]) for r in out] == [(1, 0, 7), (2, 1, 7)]


def test_a_batch_stored_again_is_not_doubled(spark, folders):
    arrive(spark, folders["in"], [(1, "2024-01-01 00:00:00", "a")])
    ingest.ingest(stream(spark, folders["in"]), folders["out"], folders["check"], 7).awaitTermination()
    spark.read.parquet(folders["out"]).drop("_batch_id").write.parquet(f"{folders['out']}/_batch_id=1")  # died before its commit
    arrive(spark, folders["in"], [(2, "2024-01-01 00:00:00", "b")])
    ingest.ingest(stream(spark, folders["in"]), folders["out"], folders["check"], 7).awaitTermination()
    assert sorted(r["user"] for r in spark.read.parquet(folders["out"]).collect()) == [1, 2]


def test_another_checkpoint_is_refused(spark, folders):
    arrive(spark, folders["in"], [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00", "b")])
    ingest.ingest(stream(spark, folders["in"]), folders["out"], folders["check"], 7).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest.ingest(stream(spark, folders["in"]), folders["out"], folders["check"] + "2", 7)
    assert spark.read.parquet(folders["out"]).count() == 2


def test_an_older_row_in_a_later_batch_loses(spark, folders):
    arrive(spark, folders["in"], [(1, "2024-01-09 00:00:00", "new")])
    arrive(spark, folders["in"], [(1, "2024-01-03 00:00:00", "old")])
    ingest.stream_upsert(stream(spark, folders["in"]), folders["out"], folders["check"], ["user"], ["ts"]).awaitTermination()
    assert ingest.read_updates(spark, folders["out"], ["user"], ["ts"]).first()["value"] == "new"
    ingest.fold_updates(spark, folders["out"], folders["table"], ["user"], ["ts"])
    arrive(spark, folders["in"], [(1, "2024-01-05 00:00:00", "older than stored"), (2, "2024-01-01 00:00:00", "x")])
    ingest.stream_upsert(stream(spark, folders["in"]), folders["out"], folders["check"], ["user"], ["ts"]).awaitTermination()
    ingest.fold_updates(spark, folders["out"], folders["table"], ["user"], ["ts"])
    assert {r["user"]: r["value"] for r in read_snapshot(spark, folders["table"]).collect()} == {1: "new", 2: "x"}


def test_upsert_later_batches_win(spark, folders):
    arrive(spark, folders["in"], [(1, "2024-01-02 00:00:00", "new"), (1, "2024-01-01 00:00:00", "old"), (2, "2024-01-01 00:00:00", "x")])
    arrive(spark, folders["in"], [(2, "2023-01-01 00:00:00", "y"), (3, "2024-01-01 00:00:00", "z")])
    ingest.stream_upsert(stream(spark, folders["in"]), folders["out"], folders["check"], ["user"], ["ts"]).awaitTermination()
    current = {r["user"]: r["value"] for r in ingest.read_updates(spark, folders["out"], ["user"]).collect()}
    assert current == {1: "new", 2: "y", 3: "z"}
    ingest.fold_updates(spark, folders["out"], folders["table"], ["user"])
    assert read_snapshot(spark, folders["table"]).count() == 3


def test_rows_behind_the_watermark_are_dropped(spark, folders):
    arrive(spark, folders["in"], [(1, "2024-01-01 10:00:00", "a")])
    arrive(spark, folders["in"], [(1, "2024-01-01 12:00:00", "b")])
    arrive(spark, folders["in"], [(2, "2024-01-01 12:00:00", "c")])  # the new watermark counts from the batch after next
    arrive(spark, folders["in"], [(1, "2024-01-01 11:52:00", "in time"), (1, "2024-01-01 10:01:00", "late")])
    counts = ingest.rate_windows(stream(spark, folders["in"]), "user", "ts", "1 hour", "1 hour")
    ingest.store_updates(counts, folders["out"], folders["check"]).awaitTermination()
    rows = ingest.read_updates(spark, folders["out"], ["window_start", "window_end", "user"]).collect()
    assert {(r["user"], r["window_start"].hour): r["requests"] for r in rows} == {(1, 10): 1, (1, 11): 1, (1, 12): 1, (2, 12): 1}


def test_windows_of_a_stream_are_spread_and_their_state_is_on_disk(spark, folders):
    """One file is copied to windows by many tasks; the state store is the one whose memory is bounded."""
    spark.range(100).selectExpr("concat('u', id % 7) AS user", "timestamp_seconds(1700000000 + id * 60) AS ts").coalesce(1).write.parquet(folders["in"])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    counts = ingest.rate_windows(spark.readStream.schema("user string, ts timestamp").parquet(folders["in"]), "user", "ts")
    ingest.store_updates(counts, folders["out"], folders["check"]).awaitTermination()
    assert "Repartition 8, true" in counts._jdf.queryExecution().analyzed().toString()
    assert spark.read.text(folders["check"] + "/offsets").where("value LIKE '%RocksDBStateStoreProvider%'").count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    plain = ingest.rate_windows(spark.read.parquet(folders["in"]), "user", "ts")
    assert sorted(map(tuple, ingest.read_updates(spark, folders["out"], ["window_start", "window_end", "user"]).collect())) == sorted(map(tuple, plain.collect()))
