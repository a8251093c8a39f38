"""Order and meaning of the silver steps."""

from __future__ import annotations

import pytest

from fernweave.config import ColumnGroup, Extraction, Relationship, SilverConfig, Transformation
from fernweave.operators.joins import UnlinkedTablesError
from fernweave.plans import bronze, extract, sharing, silver


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "M ", "x", "Keep"), (2, None, "F", "keep"), (3, "other", "y", None)], "id int, a string, b string, note string")


def rows(frame, *columns):
    return [tuple(r) for r in frame.orderBy("id").select(*columns).collect()]


def test_maps_see_raw_values_and_changes_come_after(df):
    config = SilverConfig(
        1,
        groups=(ColumnGroup("sex", ("a", "b"), {"a": {"M ": " Male"}, "b": {"F": " Female"}}),),
        transformations=(Transformation("a", "trim"), Transformation("a", "uppercase"), Transformation("b", "lowercase")),
    )
    out = silver.unify_and_transform(df, config)
    assert rows(out, "sex", "a", "b") == [("MALE", "M", "x"), (" female", None, "f"), ("OTHER", "OTHER", "y")]


def test_sources_can_be_dropped_and_filters_follow_them(df):
    config = SilverConfig(
        1, filters={"conditions": [{"column_id": 8, "operator": "=", "value": "Male"}]},
        groups=(ColumnGroup("sex", ("a",), {"a": {"M ": "Male"}}),), drop_unified_sources=True, column_ids={8: "a"},
    )
    out = silver.transform(df, config)
    assert "a" not in out.columns and rows(out, "id", "sex") == [(1, "Male")]


def test_a_group_named_like_its_source_is_still_mapped(df):
    config = SilverConfig(1, groups=(ColumnGroup("a", ("a",), {"a": {"M ": "Male"}}),))
    assert rows(silver.unify_and_transform(df, config), "a") == [("Male",), (None,), ("other",)]


def test_ungrouped_columns_are_mapped_too(df):
    config = SilverConfig(1, value_maps={"note": {"Keep": "Kept"}}, transformations=(Transformation("note", "uppercase"),))
    assert rows(silver.unify_and_transform(df, config), "note") == [("KEPT",), ("KEEP",), (None,)]


def test_raw_and_changed_values_are_different_filters(df):
    changed = SilverConfig(1, filters={"conditions": [{"column_id": 4, "operator": "=", "value": "KEEP"}]}, transformations=(Transformation(4, "uppercase"),), column_ids={4: "note"})
    assert rows(silver.transform(df, changed), "id") == [(1,), (2,)]
    raw = SilverConfig(1, filters={"conditions": [{"column_id": 4, "operator": "=", "value": "keep"}]}, column_ids={4: "note"})
    assert rows(silver.transform(df, raw), "id") == [(2,)]


def test_unlinked_sources_are_never_multiplied(spark):
    tables = {n: spark.range(2).withColumnRenamed("id", n) for n in "abc"}
    with pytest.raises(UnlinkedTablesError):
        silver.combine_sources(tables, [Relationship("a", "a", "b", "b")])


def test_extraction_outcomes(spark):
    df = spark.createDataFrame([(1, "yes"), (2, " "), (3, None), (4, "boom"), (5, "odd"), (6, "slow")], "id int, t string")
    def answer(text):
        if text == "boom":
            raise ValueError("broken")
        if text == "slow":
            raise extract.RetryableError("busy")
        return text

    out = extract.extract_column(df, Extraction("t", "v", ("yes", "no")), answer, retries=2, backoff=0.01, keep_status=True)
    got = rows(out, "v", "_v_ok", "_v_error")
    assert got == [
        ("yes", True, None), (None, True, None), (None, True, None), (None, False, "broken"),
        (None, False, "not an allowed value: 'odd'"), (None, False, "busy"),
    ]
    with pytest.raises(ValueError):
        extract.extract_column(df, Extraction("t", "v", ("yes",)), answer)


def test_retry_ends_with_the_first_answer():
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise extract.RetryableError("busy")
        return True

    assert extract.run_extractor("x", flaky, (True, False), 3, 0) == (True, True, None)


@pytest.mark.parametrize("text", ["DROP TABLE t", "SELECT 1; DROP TABLE t", "CREATE VIEW v AS SELECT 1", "SELECT 1) ; DELETE FROM t --", "SET x=1"])
def test_only_queries_run(spark, text):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|PARSE"):
        sharing.read_only_query(spark, text)


def test_query_cap_and_comment(spark):
    out = sharing.read_only_query(spark, "SELECT id FROM range(10) -- all of it", cap=4).collect()
    assert len(out) == 4 and all(r["truncated"] for r in out)


def test_log_replay_versions(spark):
    log = spark.createDataFrame([(0, 0, "a", "add"), (1, 0, "a", "remove"), (1, 1, "b", "add"), (2, 0, "a", "add")], "v int, p int, path string, action string")
    def active(version=None):
        return sorted(r[0] for r in sharing.replay_log(log, "path", "action", ["v", "p"], version).collect())

    assert active() == ["a", "b"] and active(1) == ["b"] and active(0) == ["a"]
    with pytest.raises(sharing.NoSuchVersion):
        active(3)


def test_change_feed_with_nulls_and_maps(spark):
    old = spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS v, map('a', 1) AS m UNION ALL SELECT 2, 'x', map('a', 1)")
    new = spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS v, map('a', 1) AS m UNION ALL SELECT 2, 'x', map('a', 2)")
    got = sorted((r["_change_type"], r["k"]) for r in sharing.change_feed(old, new, "k").collect())
    assert got == [("update_post", 2), ("update_pre", 2)]


def test_access_needs_an_active_recipient_and_share(spark):
    recipients = spark.sql("SELECT * FROM VALUES (1, true), (2, false) AS t(recipient_id, is_active)")
    grants = spark.sql("SELECT * FROM VALUES (1, 10), (1, 11), (2, 10) AS t(recipient_id, share_id)")
    shares = spark.sql("SELECT * FROM VALUES (10, true), (11, false) AS t(share_id, is_active)")
    tables = spark.sql("SELECT * FROM VALUES (10, 100), (10, 101), (11, 102) AS t(share_id, table_id)")
    live = sharing.live_grants(recipients, grants, shares)
    assert sorted(r[0] for r in sharing.accessible_tables(live, tables, 1).collect()) == [100, 101]
    assert sharing.accessible_tables(live, tables, 2).isEmpty()


def test_mapping_and_links_of_stored_groups(spark):
    frames = {n: spark.createDataFrame([], f"id int, {n}_x int") for n in ("a", "b", "c")}
    plan = bronze.plan_bronze({"a": "one", "b": "one", "c": "two"}, [Relationship("a", "ID", "b", "id"), Relationship("b", "id", "c", "id")])
    mappings = bronze.group_mappings(frames, plan)
    found = {(r["group_name"], r["table_name"], r["column_name"]): (r["output_name"], r["is_unified"]) for r in bronze.mapping_table(spark, mappings).collect()}
    assert found["part_one", "b", "id"] == ("id", True) and found["part_two", "c", "id"] == ("id", False)
    link = bronze.group_links(plan, mappings)[0]
    assert (link.left_table, link.left_column, link.right_table, link.right_column) == ("part_one", "id", "part_two", "id")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT `java_method`('java.lang.System', 'currentTimeMillis')",
        "SELECT * FROM no_such_view", "SELECT * FROM seen WHERE id IN (SELECT n_nationkey FROM parquet.`/root/testdata/sf0.001/nation.parquet`)",
        "WITH c AS (SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`) SELECT * FROM c", "SELECT (SELECT max(id) FROM other.seen)", "SELECT * FROM seen WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)",
        "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/nation.parquet`')", "SELECT id, try_reflect('java.lang.System', 'nanoTime') FROM seen",
    ],
)
def test_only_registered_views_can_be_read(spark, text):
    spark.range(3).createOrReplaceTempView("seen")
    with pytest.raises(Exception):
        sharing.read_only_query(spark, text)


def test_queries_over_views_run(spark):
    spark.range(3).createOrReplaceTempView("seen")
    for text in (
        "SELECT * FROM seen s JOIN SEEN t ON s.id = t.id", "WITH c AS (SELECT id FROM seen) SELECT * FROM c WHERE id IN (SELECT id FROM seen)",
        "SELECT id, (SELECT max(id) FROM seen) AS m FROM seen ORDER BY id", "SELECT * FROM seen LATERAL VIEW explode(array(1)) e AS x", "SELECT explode(array(1, 2, 3))",
    ):
        assert sharing.read_only_query(spark, text).count() == 3


def test_keyword_rules_agree_in_both_forms(spark):
    texts = ["See HTTP://x", "www", "none", "", " ", None, "Que the", "QUE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rule, values in ((extract.keyword_flag(["http", "WWW"]), None), (extract.keyword_choice({"a": ["the"], "b": ["que"]}, "c"), ("a", "b", "c"))):
        native = extract.extract_column(df, Extraction("t", "v", values), rule)
        python = extract.extract_column(df, Extraction("t", "v", values), lambda text, rule=rule: rule(text))
        assert [r["v"] for r in native.collect()] == [r["v"] for r in python.collect()]
