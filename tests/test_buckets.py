"""Upserts that rewrite only the buckets they touch, and folds that read only new batches."""

from __future__ import annotations

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fernweave.session import work_folder
from fernweave.sinks.buckets import read_buckets, upsert_buckets
from fernweave.streaming import ingest
from tests.test_streams import arrive, stream

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def files(path: str) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path: str) -> list[tuple]:
    return sorted(map(tuple, read_buckets(spark, path).collect()), key=repr)


def test_one_key_rewrites_one_bucket(spark):
    path = work_folder(spark, "buckets")
    upsert_buckets(spark.range(1000).selectExpr("id AS k", "'old' AS v"), path, ["k"], buckets=16)
    before = files(path)
    touched = upsert_buckets(spark.sql("SELECT 77L AS k, 'new' AS v"), path, ["k"])
    after = files(path)
    assert len(touched) == 1 and before - after == {f for f in before if f"_bucket={touched[0]}/" in f}
    assert {f for f in after - before if f"_bucket={touched[0]}/" not in f} == set()
    assert rows(spark, path) == sorted([(k, "new" if k == 77 else "old") for k in range(1000)], key=repr)
    assert upsert_buckets(spark.sql("SELECT 1L AS k, 'x' AS v WHERE false"), path, ["k"]) == [] and files(path) == after


@FEW
@given(batches=st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5), st.sampled_from("abc")), max_size=8), min_size=1, max_size=3))
def test_any_batches_follow_a_dictionary(spark, batches):
    path, held = work_folder(spark, "buckets"), {}
    for batch in batches:
        unique = list({(k, s): (k, s, v) for k, s, v in batch}.values())
        for k, s, v in unique:
            if k not in held or s >= held[k][0]:
                held[k] = (s, v)
        upsert_buckets(spark.createDataFrame(unique, "k bigint, s int, v string"), path, ["k"], ["s"], buckets=4)
    if held:
        assert rows(spark, path) == sorted([(k, s, v) for k, (s, v) in held.items()], key=repr)


def test_columns_come_and_stay(spark):
    path = work_folder(spark, "buckets")
    upsert_buckets(spark.sql("SELECT * FROM VALUES (1L, 'a', 1), (2L, 'b', 2) AS t(k, v, n)"), path, ["k"], buckets=2)
    upsert_buckets(spark.sql("SELECT * FROM VALUES (2, 'B'), (3, 'C') AS t(k, v)"), path, ["k"])  # keys of another type
    upsert_buckets(spark.sql("SELECT 1L AS k, 'z' AS extra"), path, ["k"])
    got = {r["k"]: (r["v"], r["n"], r["extra"]) for r in read_buckets(spark, path).collect()}
    assert got == {1: ("a", 1, "z"), 2: ("B", 2, None), 3: ("C", None, None)}


def test_bad_keys_are_refused(spark):
    path = work_folder(spark, "buckets")
    for sql, message in (("(1, 'a'), (1, 'b')", "repeated"), ("(NULL, 'a')", "NULL")):
        with pytest.raises(ValueError, match=message):
            upsert_buckets(spark.sql(f"SELECT * FROM VALUES {sql} AS t(k, v)"), path, ["k"])


def test_a_second_fold_reads_only_new_batches(spark):
    source, out, check, table = (work_folder(spark, n) for n in ("in", "out", "check", "table"))
    for n, data in enumerate(([(1, "2024-01-05 00:00:00", "a"), (2, "2024-01-01 00:00:00", "b")], [(1, "2024-01-02 00:00:00", "older"), (3, "2024-01-01 00:00:00", "c")])):
        arrive(spark, source, data)
        ingest.stream_upsert(stream(spark, source), out, check, ["user"], ["ts"]).awaitTermination()
        assert ingest.new_batches(spark, out) == [n]
        waiting = {r["user"]: r["value"] for r in ingest.read_current(spark, out, table, ["user"], ["ts"]).collect()}
        assert ingest.fold_new_batches(spark, out, table, ["user"], ["ts"], 4) == [n]
        folded = {r["user"]: r["value"] for r in ingest.read_current(spark, out, table, ["user"], ["ts"]).collect()}
        assert waiting == folded
    assert folded == {1: "a", 2: "b", 3: "c"}
    assert ingest.fold_new_batches(spark, out, table, ["user"], ["ts"]) == []


def test_an_unfinished_batch_waits(spark):
    out = work_folder(spark, "out")
    spark.sql("SELECT 1 AS user").write.parquet(f"{out}/_batch_id=0")
    spark.sql("SELECT 2 AS user").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/_batch_id=1")
    assert ingest.new_batches(spark, out) == [0]


def test_two_writers_with_one_number_keep_their_own_rows(spark, monkeypatch):
    from fernweave.sinks import snapshots
    from fernweave.sources.snapshots import commits, read_snapshot

    path = work_folder(spark, "raced")
    monkeypatch.setattr(snapshots, "_claim_version", lambda *_: 0)
    for n in (5, 3):
        snapshots.write_snapshot(spark.range(n), path)
    assert read_snapshot(spark, path).count() == 3  # the later commit, whole
    assert sorted(spark.read.parquet(f"{path}/{r['folder']}").count() for r in commits(spark, path).collect()) == [3, 5]


def test_expiry_is_one_write(spark):
    import datetime as dt

    from fernweave.sinks import snapshots

    path, old = work_folder(spark, "expired"), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for n in range(4):
        snapshots.write_snapshot(spark.range(n), path, at=old + dt.timedelta(days=n))
    before = len(os.listdir(f"{path}/_commits"))
    assert snapshots.expire(spark, path, old + dt.timedelta(days=30)) == [0, 1, 2]
    assert len(os.listdir(f"{path}/_commits")) == before + 1
