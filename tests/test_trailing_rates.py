"""Trailing rates on a stream against the plain form, with late rows told apart."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql.types import StructType

from fernweave.operators.aggregates import rate_check
from fernweave.session import work_folder
from fernweave.streaming import ingest, rates

SCHEMA = "user string, ts timestamp"


def run(spark, folders, data):
    """Write one file of (user, second) and take it in."""
    rows = spark.createDataFrame([(u, float(s)) for u, s in data], "user string, s double").selectExpr("user", "timestamp_millis(cast(s * 1000 AS bigint)) AS ts")
    rows.coalesce(1).write.mode("append").parquet(folders["in"])
    stream = ingest.file_stream(spark, folders["in"], StructType.fromDDL(SCHEMA))
    found = rates.trailing_rates(stream, "user", "ts", 60, 3, "10 seconds")
    rates.store_trailing_rates(found, folders["out"], folders["check"]).awaitTermination()


def test_stream_equals_plain_form_and_reports_late_rows(spark):
    folders = {n: work_folder(spark, n) for n in ("in", "out", "check")}
    draw = random.Random(3)
    base, on_time, late = 1_700_000_000, [], []
    batches = []
    for step in range(3):
        top = base + (step + 1) * 100
        closed = None if step == 0 else base + step * 100 - 10
        batch = [(draw.choice(["busy", "busy", "a", "b", None]), base + step * 100 + draw.randrange(100) + 0.25) for _ in range(120)] + [("edge", top)]
        if closed:
            batch += [("busy", closed - 1 + 0.999), ("busy", closed - 1), ("busy", closed), (None, closed - 200)]
            late += [("busy", closed - 1, 2), (None, closed - 200, 1)]
        batches.append(batch)
        on_time += [r for r in batch if closed is None or r[1] >= closed]
        run(spark, folders, batch)
    out = spark.read.parquet(folders["out"]).collect()
    assert sorted((str(r["user"]), r["second"], r["requests"]) for r in out if r["late"]) == sorted((str(u), s, n) for u, s, n in late)
    assert all(r["in_window"] is None and r["exceeded"] is None for r in out if r["late"])

    plain = rate_check(spark.createDataFrame([(u, float(s)) for u, s in on_time], "user string, s double").selectExpr("user", "timestamp_millis(cast(s * 1000 AS bigint)) AS ts"), "user", "ts", 60, 3)
    want = sorted((str(r["user"]), r["second"], r["requests"], r["in_window"], r["exceeded"]) for r in plain.collect() if r["second"] < base + 290)
    assert sorted((str(r["user"]), r["second"], r["requests"], r["in_window"], r["exceeded"]) for r in out if not r["late"]) == want
    assert any(r[4] for r in want) and any(not r[4] for r in want)


def test_seconds_are_reported_once_the_watermark_has_passed_their_end(spark):
    folders = {n: work_folder(spark, n) for n in ("in", "out", "check")}
    run(spark, folders, [("a", 1_000_000), ("a", 1_000_000.5), ("b", 1_000_010.999)])  # the watermark stops 1 ms short of the end
    assert spark.read.schema("user string").parquet(folders["out"]).count() == 0
    run(spark, folders, [("b", 1_000_011)])
    assert [(r["user"], r["second"], r["requests"], r["late"]) for r in spark.read.parquet(folders["out"]).collect()] == [("a", 1_000_000, 2, False)]


def test_trailing_sums_of_a_group_of_requesters():
    """Many requesters in one call, NULL and whole numbers that a double cannot tell apart among them."""
    draw = random.Random(4)
    who = [draw.choice([None, 2**60, 2**60 + 1, -3, 0]) for _ in range(400)]
    arrived = pa.table({"who": pa.array(who, pa.int64()), "second": pa.array([draw.randrange(-200, 200) for _ in who], pa.int64()), "n": pa.array([1] * len(who), pa.int64())})
    counts = rates._unpacked([rates._packed(arrived.slice(0, 150)), rates._packed(arrived.slice(150))])
    seen = list(zip(who, arrived["second"].to_pylist()))
    want = [sum(w == x and s - 60 <= at <= s for x, at in seen) for w, s in zip(counts["who"].to_pylist(), counts["second"].to_pylist())]
    assert rates._Trailing("user", 60, 3)._trailing(counts).tolist() == want
    assert counts["n"].to_pylist() == [seen.count(k) for k in zip(counts["who"].to_pylist(), counts["second"].to_pylist())]
