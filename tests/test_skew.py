"""One key holding a third of all rows: results stay whole and no task gets the group."""

from __future__ import annotations

import json

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.operators import aggregates, joins, paging, ranking, sets

FEW = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
ROWS = st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3, None]), st.integers(0, 9)), max_size=12)


def brute_join(left, right, how):
    out, used = [], set()
    for a, x in left:
        hits = [(i, y) for i, (b, y) in enumerate(right) if a is not None and a == b]
        used |= {i for i, _ in hits}
        out += [(a, x, a, y) for _, y in hits]
        if not hits and how in ("left", "full"):
            out.append((a, x, None, None))
    if how in ("right", "full"):
        out += [(None, None, b, y) for i, (b, y) in enumerate(right) if i not in used]
    return Counter(out)


@FEW
@given(left=ROWS, right=ROWS, how=st.sampled_from(["inner", "left", "right", "full"]), flags=st.tuples(st.booleans(), st.booleans()))
def test_keyed_join_follows_sql(spark, left, right, how, flags):
    """Whatever is claimed about uniqueness, the result is the join's."""
    a, b = spark.createDataFrame(left, "a int, x int"), spark.createDataFrame(right, "b int, y int")
    got = joins.keyed_join(a, b, [("a", "b")], how, right_unique=flags[0], left_unique=flags[1])
    assert Counter(tuple(r) for r in got.collect()) == brute_join(left, right, how)


@pytest.fixture(scope="module")
def skewed(spark):
    """60 000 log rows, a third of them by requester 0."""
    at = F.expr("timestamp_seconds(1704067200 + id * 7)")
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("who"), at.alias("at"), F.col("id").alias("seq"),
        F.concat(F.lit("v"), F.col("id") % 11).alias("value"),
    )


def test_rate_check_on_a_hot_requester(skewed):
    rows = [(r["who"], int(r["at"].timestamp())) for r in skewed.collect()]
    times = defaultdict(list)
    for who, second in rows:
        times[who].append(second)
    got = aggregates.rate_check(skewed, "who", "at", 600, 20).collect()
    assert sum(r["requests"] for r in got) == len(rows)
    for r in random.Random(1).sample(got, 300):
        want = sum(r["second"] - 600 <= s <= r["second"] for s in times[r["who"]])
        assert r["in_window"] == want and r["exceeded"] == (want >= 20)


def test_rate_check_counts_whole_seconds(spark):
    df = spark.sql("SELECT 1 AS who, explode(array(0, 0, 3600, 3601, 7200)) AS s").select("who", F.timestamp_seconds("s").alias("at"))
    got = {r["second"]: r["in_window"] for r in aggregates.rate_check(df, "who", "at", 3600, 3).collect()}
    assert got == {0: 2, 3600: 3, 3601: 2, 7200: 3}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_per_key_are_limited_before_the_shuffle(skewed):
    assert "partial_max_by" in plan(sets.keep_last(skewed, ["who"], ["seq"])).split("Exchange hashpartitioning(who", 1)[1]
    for df in (
        sets.prefer_filled(skewed, ["who"], "value", ["seq"]),
        ranking.first_per_key(skewed, ["who"], [F.col("seq")], 5), paging.history(skewed, "who", ["seq"], 3),
    ):
        text = plan(df)
        assert "WindowGroupLimit" in text.split("Exchange hashpartitioning(who", 1)[1]


def test_many_rows_per_key_are_limited_in_parts(skewed):
    got = ranking.first_per_key(skewed, ["who"], [F.col("seq")], 1500)
    assert plan(got).count("Window [") == 2
    hot = [r["seq"] for r in got.where("who = 0").collect()]
    assert sorted(hot) == [i for i in range(60_000) if i % 3 == 0 or i % 97 == 0][:1500]


def test_profile_of_columns_with_nulls_and_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1), 'x'), (1, map('a', 1), NULL), (NULL, map('b', 1), NULL) AS t(n, m, s)")
    rows = {r["column_name"]: r for r in aggregates.column_profile(df).collect()}
    assert (rows["n"]["non_null_count"], rows["n"]["unique_count"], rows["n"]["mean"], rows["n"]["median"]) == (2, 1, 1.0, 1.0)
    assert rows["n"]["non_null_percentage"] == 66.67 and rows["m"]["unique_count"] == 2 and rows["s"]["sample_values"] == '["x"]'
    empty = {r["column_name"]: r for r in aggregates.column_profile(df.where("n > 5")).collect()}
    assert empty["n"]["non_null_percentage"] == 0 and empty["n"]["median"] is None and empty["s"]["sample_values"] == "[]"


def test_history_of_a_hot_key(skewed):
    newest = paging.history(skewed, "who", ["seq"], 2).where("who = 0").orderBy("seq").collect()
    total = skewed.where("who = 0").count()
    assert [r["version"] for r in newest] == [total - 2, total - 1]


def test_merged_lists_are_dealt_over_parts_and_nothing_is_lost(skewed):
    merged = aggregates.merge_records(skewed.withColumn("many", F.col("seq")), "who", ["value", "many"], ["value"], part_size=100)
    assert merged.where("part = 0").count() == 97
    hot = merged.where("who = 0").collect()
    assert next(r for r in hot if r["part"] == 0)["value"].startswith('["v0","v1"')
    many = [v for r in hot if r["many"] for v in json.loads(r["many"])]
    assert len(many) == len(set(many)) == skewed.where("who = 0").count()
    assert max(len(json.loads(r["many"])) for r in hot if r["many"]) < 200


def test_1500_values_of_one_key(spark):
    rows = spark.range(1500).selectExpr("1 AS k", "concat('v', id) AS v")
    merged = aggregates.merge_records(rows, "k", ["v"])
    assert sorted(v for r in merged.collect() for v in json.loads(r["v"])) == sorted(f"v{i}" for i in range(1500))
    assert aggregates.count_merged(rows, "k", "v").count() == 1500
    assert aggregates.count_multi_valued(merged, "v").count() == 1500


def test_category_examples_are_few(skewed):
    row = aggregates.category_table(skewed, "who", "seq").where("name = 0").first()
    assert row["examples"] == "[0,3,6,9,12]"


def test_diff_applied_to_the_old_gives_the_new(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    diff = {r["k"]: (r["change"], r["changed_fields"]) for r in aggregates.snapshot_diff(old, new, "k", ["v"]).collect()}
    assert diff == {1: ("removed", None), 2: ("changed", "v"), 4: ("new", None)}
    assert aggregates.snapshot_diff(new, new, "k", ["v"]).isEmpty()


def test_pairs_in_either_direction(spark):
    df = spark.createDataFrame([(1, 2, 0.5, "x"), (2, 1, 0.9, "y"), (3, 4, 0.1, "z")], "a int, b int, score double, t string")
    assert sorted(r["t"] for r in sets.best_pairs(df, "a", "b", "score", ["t"]).collect()) == ["y", "z"]
    known = spark.createDataFrame([(2, 1)], "a int, b int")
    assert [r["t"] for r in sets.exclude_pairs(df, known, "a", "b").collect()] == ["z"]


@pytest.fixture
def small_partitions(spark):
    """Settings under which test data counts as large: no broadcast, tiny skew threshold."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def counted_keys(monkeypatch):
    """Test data are large enough to be looked at, and 5000 rows make a key heavy."""
    monkeypatch.setattr(joins, "HOT_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 5000)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("known", [True, False])
def test_hot_keys_are_split_in_every_join(spark, skewed, small_partitions, counted_keys, how, known):
    """A requester with a third of the log is read by several tasks, also in outer joins."""
    people = spark.range(5, 105).select(F.col("id").alias("person"), F.col("id").cast("string").alias("name"))
    people = people.unionByName(spark.sql("SELECT 0L AS person, 'zero' AS name"))
    log = skewed.repartition(8).select("who", "seq", "value", F.sha2(F.col("seq").cast("string"), 256).alias("pad"))
    out = joins.keyed_join(log, people, [("who", "person")], how, right_unique=known)
    rows = out.collect()
    final = plan(out)
    assert "skew=true" in final
    names = {r["person"]: r["name"] for r in people.collect()}
    kept = [r["who"] for r in log.select("who").collect() if how in ("left", "full") or r["who"] in names]
    assert Counter(r["who"] for r in rows if r["seq"] is not None) == Counter(kept)
    lonely = {p for p in names if p > 96} | {1, 2, 3, 4} & set(names)
    assert {r["person"] for r in rows if r["seq"] is None} == (lonely if how in ("right", "full") else set())


def test_heavy_keys_are_found(spark, skewed, counted_keys):
    zero = spark.sql("SELECT xxhash64(0L) AS h").first()["h"]
    assert joins.hot_keys(skewed, ["who"]) == {zero}
    assert joins.hot_keys(skewed.select(F.lit(None).cast("long").alias("who")), ["who"]) == set()
    joins.HOT_BYTES = 1 << 40
    assert joins.hot_keys(skewed, ["who"]) == set()


@FEW
@given(left=ROWS, right=ROWS, how=st.sampled_from(["left", "right", "full"]), extra=st.booleans(), heavy=st.sets(st.sampled_from([1, 2, 3, 9])))
def test_any_choice_of_heavy_keys_gives_the_same_rows(spark, left, right, how, extra, heavy):
    """Also with a condition, by which rows of a matching key stay alone."""
    a, b = spark.createDataFrame(left, "a int, x int"), spark.createDataFrame(right, "b int, y int")
    hashes = {r["h"] for r in spark.createDataFrame([(k,) for k in heavy], "k int").selectExpr("xxhash64(k) AS h").collect()}
    condition = "x < y" if extra else None
    got = joins.keyed_join(a, b, [("a", "b")], how, condition, hot=hashes).collect()
    plain = a.join(b, F.expr("a = b" + " AND x < y" * extra), how).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, plain))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_a_heavy_key_with_a_condition_is_split(spark, skewed, small_partitions, counted_keys, how):
    people = spark.sql("SELECT explode(array(0L, 0L, 5L, 500L)) AS person").withColumn("low", F.lit(30_000))
    log = skewed.repartition(8).select("who", "seq", F.sha2(F.col("seq").cast("string"), 256).alias("pad"))
    out = joins.keyed_join(log, people, [("who", "person")], how, "seq < low")
    rows = out.collect()
    assert "skew=true" in plan(out)
    seqs = Counter(r["seq"] for r in rows if r["seq"] is not None)
    hot = [i for i in range(60_000) if i % 3 == 0 or i % 97 == 0]
    assert sum(seqs[i] for i in hot) == (2 * sum(i < 30_000 for i in hot) + (sum(i >= 30_000 for i in hot) if how != "right" else 0))
    assert [r["person"] for r in rows if r["seq"] is None] == ([500] if how != "left" else [])


def test_keys_of_unlike_types_are_not_taken_apart(spark, counted_keys):
    a, b = spark.range(9).selectExpr("cast(id AS int) AS a"), spark.range(4, 12).selectExpr("id AS b")
    assert joins.keyed_join(a, b, [("a", "b")], "full", hot={42}).count() == 12


def test_catalog_merge_replaces_what_was_extracted_again(spark):
    from fernweave.sources.catalog import column_catalog, merge_catalog

    old = column_catalog(spark, {"a": spark.range(1), "b": spark.range(1)})
    new = column_catalog(spark, {"a": spark.range(1).selectExpr("CAST(id AS STRING) AS id", "1 AS x")})
    merged = {(r["table_name"], r["column_name"]): r["data_type"] for r in merge_catalog(old, new).collect()}
    assert merged == {("a", "id"): "string", ("a", "x"): "int", ("b", "id"): "bigint"}
