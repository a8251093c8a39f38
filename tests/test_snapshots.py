"""Versioned tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fernweave.session import work_folder
from fernweave.sinks import snapshots, tables
from fernweave.sources.snapshots import VersionNotFound, commits, history, read_snapshot, table_schema

DAY = [dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc) for d in range(1, 31)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def path(spark):
    return work_folder(spark, "table")


@pytest.fixture
def three(spark, path):
    for n, day in ((1, DAY[0]), (2, DAY[9]), (3, DAY[19])):
        snapshots.write_snapshot(spark.range(n), path, at=day)
    return path


def test_versions_times_and_pins(spark, three):
    assert read_snapshot(spark, three).count() == 3
    assert read_snapshot(spark, three, version=0).count() == 1
    assert read_snapshot(spark, three, as_of=DAY[10]).count() == 2
    assert read_snapshot(spark, three, version=2, pinned=1).count() == 2
    with pytest.raises(VersionNotFound):
        read_snapshot(spark, three, version=3)
    with pytest.raises(VersionNotFound):
        read_snapshot(spark, three, as_of=dt.datetime(2023, 1, 1))


def test_a_write_that_died_is_not_seen(spark, three):
    spark.range(99).write.parquet(f"{three}/_version=3")  # data without a commit row
    assert read_snapshot(spark, three).count() == 3
    done = snapshots.write_snapshot(spark.range(4), three, at=DAY[25])
    assert done.version == 3 and read_snapshot(spark, three).count() == 4


def test_commit_rows(spark, three):
    newest = history(spark, three, 2).collect()
    assert [(r["version"], r["rows"], r["operation"]) for r in newest] == [(2, 3, "overwrite"), (1, 2, "overwrite")]
    assert table_schema(spark.range(1))["fields"][0]["name"] == "id"


def test_expiry_spares_the_newest(spark, three):
    assert snapshots.expire(spark, three, now=DAY[28]) == [0, 1]
    assert snapshots.expire(spark, three, now=DAY[29] + dt.timedelta(days=300)) == []
    with pytest.raises(VersionNotFound):
        read_snapshot(spark, three, version=1)
    assert read_snapshot(spark, three).count() == 3
    assert snapshots.write_snapshot(spark.range(5), three).version == 3


def test_upsert_rules(spark, path):
    def frame(data, ddl="k int, v string, n int"):
        return spark.createDataFrame(data, ddl)

    snapshots.upsert(frame([(1, "a", 1), (2, "b", 1)]), path, ["k"])
    snapshots.upsert(frame([(2, "x", 1), (2, "y", 2), (3, "c", 1)]), path, ["k"], ["n"])
    assert rows(read_snapshot(spark, path)) == [(1, "a", 1), (2, "y", 2), (3, "c", 1)]
    snapshots.upsert(frame([(1, 5)], "other int, w int"), path, ["other"])  # key column absent: starts again
    assert rows(read_snapshot(spark, path)) == [(1, 5)]
    assert [r["operation"] for r in commits(spark, path).orderBy("version").collect()] == ["create", "upsert", "recreate"]


def test_write_only_when_changed(spark, path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert snapshots.write_if_changed(df, path, "k", ["v"]).version == 0
    assert snapshots.write_if_changed(df, path, "k", ["v"]) is None
    assert snapshots.write_if_changed(df.limit(0), path, "k", ["v"]).version == 1


def test_compaction_keeps_rows_and_needs_enough_of_them(spark, path):
    snapshots.write_snapshot(spark.range(500).repartition(8), path)
    assert snapshots.compact(spark, path) is None
    done = snapshots.compact(spark, path, min_rows=100)
    assert done.files == 1 and read_snapshot(spark, path).count() == 500


def test_partitioned_read_opens_one_folder(spark, path):
    tables.write_partitioned(spark.range(100).selectExpr("id", "id % 4 AS part"), path, ["part"])
    df = spark.read.parquet(path).where("part = 2")
    assert df.count() == 25
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_execution_versions_count_per_config(spark, path):
    for config in (1, 1, 2):
        outcome = tables.run_groups({"ok": lambda: "p1", "bad": lambda: 1 / 0})
        tables.log_execution(spark, path, config, outcome, DAY[0], 1, 1, {})
    log = spark.read.parquet(path)
    assert rows(log.select("id", "config_id", "version", "status")) == [(1, 1, 0, "partial"), (2, 1, 1, "partial"), (3, 2, 0, "partial")]
    assert "division by zero" in log.first()["error"]
    assert rows(tables.known_paths(log)) == [("p1",)]


def test_validation_of_exports(spark, path):
    absent = tables.validate_export(spark, path, path).first()
    assert not absent["valid"] and "cannot read" in absent["errors"]
    spark.createDataFrame([], "record_type string").write.parquet(path)
    empty = tables.validate_export(spark, path, path).first()
    assert empty["valid"] and empty["row_count"] == 0 and empty["warnings"] == "table is empty"


def test_two_writers_keep_both_results(spark, path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda n: (snapshots.write_snapshot(spark.range(n), path), n), (11, 12, 13, 14)))
    assert len({c.version for c, _ in done}) == 4
    assert all(read_snapshot(spark, path, version=c.version).count() == n for c, n in done)


def test_upsert_keeps_columns_the_batch_lacks(spark, path):
    snapshots.upsert(spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, name string, v int"), path, ["k"])
    snapshots.upsert(spark.createDataFrame([(1, 11), (3, 30)], "k int, v int"), path, ["k"])
    assert rows(read_snapshot(spark, path).select("k", F.coalesce("name", F.lit("-")), "v")) == [(1, "a", 11), (2, "b", 20), (3, "-", 30)]


def test_upsert_refuses_null_and_repeated_keys(spark, path):
    for bad in ([(None, 1)], [(1, 1), (1, 2)]):
        with pytest.raises(ValueError):
            snapshots.upsert(spark.createDataFrame(bad, "k int, v int"), path, ["k"])
    snapshots.upsert(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), path, ["k"], ["v"])
    assert rows(read_snapshot(spark, path)) == [(1, 2)]
