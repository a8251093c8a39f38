"""Plans: what must not appear in any query, and what must reach the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fernweave import queries

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"python_rule", "all_accents_removed"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_all_pairs_join_and_no_row_python(spark, name):
    text = plan(queries.all_queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text
    assert ("ArrowEvalPython" in text or "MapInPandas" in text) <= (name in PYTHON)


def test_windows_are_always_partitioned(spark):
    for name in ("newest_history", "first_rows_per_group", "hourly_rate", "prefer_filled"):
        df = queries.all_queries()[name](spark, FOLDER)
        assert "Exchange SinglePartition" not in plan(df)


def test_pages_are_top_k(spark):
    for name in ("offset_page", "date_sorted_page", "token_page", "table_preview"):
        assert "TakeOrderedAndProject" in plan(queries.all_queries()[name](spark, FOLDER))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(queries.all_queries()["inline_comparisons"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThan(l_quantity,40.5)" in text
    tree = plan(queries.all_queries()["predicate_tree"](spark, FOLDER))
    assert "Or(LessThan(l_quantity,10.0),GreaterThanOrEqual(l_quantity,45.0))" in tree
    view = queries.all_queries()["virtual_view"](spark, FOLDER).select("c_name", "o_totalprice")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan(view)
    keyset = plan(queries.all_queries()["keyset_page"](spark, FOLDER))
    assert "GreaterThan(o_orderkey,300)" in keyset


def test_a_known_cardinality_saves_passes(spark):
    """Customer to orders to nation: one pass over each table, nothing is unioned."""
    text = plan(queries.all_queries()["virtual_view"](spark, FOLDER))
    assert text.count("FileScan") == 3 and "Union" not in text


def test_listing_files_does_not_read_them(spark):
    from fernweave.sources.files import list_files

    text = plan(list_files(spark, FOLDER).agg(F.sum("length")))
    assert "ReadSchema: struct<length:bigint>" in text


def _chain(spark):
    from fernweave.config import Relationship

    tables = {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("customer", "orders", "nation")}
    links = [Relationship("customer", "c_custkey", "orders", "o_custkey", "full"), Relationship("customer", "c_nationkey", "nation", "n_nationkey", "full")]
    return tables, links


def test_building_a_chain_of_outer_joins_runs_nothing(spark, tmp_path):
    """No job is run and nothing is written before an action; each table is read once."""
    from fernweave.operators.joins import join_related

    tables, links = _chain(spark)
    group = "outer-chain"
    spark.sparkContext.setJobGroup(group, group)
    joined, _ = join_related(tables, links)
    text = plan(joined)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert text.count("FileScan") == 3 and "Union" not in text


def test_filters_reach_the_scans_of_a_chain_of_full_joins(spark):
    """A condition on one table makes its scan smaller; one on a unified key those of both its tables."""
    from fernweave.config import SilverConfig
    from fernweave.plans import silver

    tables, links = _chain(spark)
    conditions = [{"column_name": "c_nationkey", "operator": "<", "value": 7}, {"column_name": "o_totalprice", "operator": ">", "value": 1000}]
    config = SilverConfig(1, filters={"conditions": conditions})
    view = silver.virtual_view(tables, links, config)
    text = plan(view)
    assert "LessThan(c_nationkey,7)" in text and "LessThan(n_nationkey,7)" in text and "GreaterThan(o_totalprice,1000.0)" in text
    whole = silver.combine_sources(tables, links).where("c_nationkey < 7 AND o_totalprice > 1000")
    assert view.exceptAll(whole).isEmpty() and whole.exceptAll(view).isEmpty() and not view.isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("condition", [{"operator": "=", "value": 2}, {"operator": "IS NULL"}, {"operator": "!=", "value": 2}, {"operator": "NOT IN", "values": [1, 3]}])
def test_key_conditions_before_the_join_change_nothing(spark, how, condition):
    from fernweave.config import Relationship, SilverConfig
    from fernweave.plans import silver

    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (5, "q")], "k int, va string"),
        "b": spark.createDataFrame([(2, "i"), (3, "j"), (None, "m"), (1, "o")], "kb int, vb string"),
        "c": spark.createDataFrame([(2, "r"), (3, "s"), (5, "t"), (7, "u"), (None, "v")], "kc int, vc string"),
    }
    links = [Relationship("a", "k", "b", "kb", how), Relationship("a", "k", "c", "kc", how)]
    config = SilverConfig(1, filters={"conditions": [{"column_name": "k", **condition}]})
    early = silver.virtual_view(tables, links, config)
    joined = silver.combine_sources(tables, links)
    late = silver.filter_rows(joined, config.filters)
    assert sorted(map(repr, early.collect())) == sorted(map(repr, late.collect()))
