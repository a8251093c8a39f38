"""Diffs by bucket digests, and summaries that are merged."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernweave.operators import aggregates as agg
from fernweave.operators import digests, sketches
from fernweave.plans import sharing

FIELDS = ["a", "b", "m"]
SCHEMA = "k long, a string, b double, m map<string, int>"



def tables(spark):
    rows = [(i, None if i % 7 == 0 else f"v{i % 50}", float(i % 13), {"x": i % 3}) for i in range(5000)]
    rows += [(None, "no key", 1.0, None)]
    later = [r for r in rows if r[0] is None or r[0] % 1000 != 5]
    later = [(k, "changed", b, m) if k == 77 else (k, a, None, m) if k == 78 else (k, a, b, {"x": 9}) if k == 79 else (k, a, b, m) for k, a, b, m in later]
    later += [(9001, "x", 0.0, None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(later, SCHEMA).repartition(7)


@pytest.mark.parametrize("buckets", [1, 64, digests.BUCKETS])
def test_same_differences_as_a_whole_join(spark, buckets):
    old, new = tables(spark)
    fields = ["a", "b"]
    whole = agg.snapshot_diff(old, new, "k", fields).collect()
    assert Counter(agg.snapshot_diff(old, new, "k", fields, buckets=buckets).collect()) == Counter(whole)
    assert sorted(r.k for r in whole if r.change == "changed") == [77, 78]
    feed = sharing.change_feed(old, new, "k").select("_change_type", "k", "a", "b").collect()
    fewer = sharing.change_feed(*digests.differing_rows(old, new, "k", FIELDS, buckets), "k").select("_change_type", "k", "a", "b").collect()
    assert Counter(fewer) == Counter(feed) and any(r.k == 79 for r in feed)


def test_rows_of_equal_buckets_stay_where_they_are(spark):
    old, new = tables(spark)
    kept = digests.differing_rows(old, new, "k", FIELDS)
    assert max(df.count() for df in kept) <= 40  # 9 changed keys of 5000, their buckets' rows, and the row without a key
    physical = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical
    above = physical.split("BroadcastHashJoin")[0]
    assert "hashpartitioning(k" not in physical and "Exchange" not in above


def test_digests_do_not_depend_on_order_and_tell_nulls_and_repeats(spark):
    def digest(rows):
        return digests.bucket_digests(spark.createDataFrame(rows, "k long, a string, b string"), "k", ["a", "b"], 1).collect()

    rows = [(i, f"a{i}", None) for i in range(100)]
    assert digest(rows) == digest(rows[::-1])
    assert digest([(1, "x", None)]) != digest([(1, None, "x")])
    assert digest([(1, "x", "y")] * 2) != digest([(1, "x", "y")] * 4)
    assert digest([(None, "x", "y")]) == []


def test_equal_and_empty_tables_have_no_differences(spark):
    old, _ = tables(spark)
    old = old.where("k IS NOT NULL")
    assert agg.snapshot_diff(old, old.repartition(3), "k", ["a"], buckets=64).count() == 0
    none = old.limit(0)
    assert agg.snapshot_diff(none, none, "k", ["a"], buckets=64).count() == 0
    assert agg.snapshot_diff(none, old, "k", ["a"], buckets=64).where("change = 'new'").count() == old.count()


def test_merged_summaries_are_within_their_stated_error(spark):
    skewed = spark.range(200_000).select((F.col("id") % 8).alias("batch"), F.floor(F.pow(F.rand(3), 6) * 50_000).cast("long").alias("v"))
    exact = {r.v: r["count"] for r in skewed.groupBy("v").count().collect()}
    parts = sketches.summarise_values(skewed, "v", ["batch"], tracked=500)
    got = sketches.frequent_values(sketches.merge_summaries(parts), 20, tracked=500).collect()
    assert len(got) == 20 and all(0 < r.may_be_off_by for r in got)
    assert all(abs(r["count"] - exact[r.value]) <= r.may_be_off_by for r in got)
    few = skewed.withColumn("v", F.col("v") % 40)
    want = {r.v: r["count"] for r in few.groupBy("v").count().collect()}
    merged = sketches.merge_summaries(sketches.summarise_values(few, "v", ["batch"], tracked=500))
    assert {r.value: (r["count"], r.may_be_off_by) for r in sketches.frequent_values(merged, 100, tracked=500).collect()} == {v: (n, 0) for v, n in want.items()}
    assert sketches.distinct_estimates(merged).collect() == [(200_000, 40)]


def test_summaries_of_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "g string, v string")
    made = sketches.summarise_values(rows, "v", ["g"])
    assert [(r.g, r.value, r["count"]) for r in sketches.frequent_values(made, 5, ["g"]).collect()] == [("a", "x", 1)]
    assert sketches.frequent_values(sketches.merge_summaries(made.limit(0), ["g"]), 5, ["g"]).count() == 0
