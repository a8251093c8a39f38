"""Deep pages against a full sort."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fernweave.operators import paging

SORTS = [
    [("id", "asc")],
    [("id", "desc")],
    [("few", "asc"), ("id", "desc")],
    [("few", "desc"), ("gaps", "desc"), ("id", "asc")],
    [("gaps", "asc"), ("id", "asc")],
    [("gaps", "desc"), ("text", "asc"), ("id", "desc")],
    [("text", "desc"), ("id", "asc")],
    [("at", "desc"), ("id", "asc")],
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages")) + "/t"
    rows = spark.range(30_000).selectExpr(
        "id", "id % 3 AS few", "if(id % 4 = 0, NULL, if(id % 4 = 1, double('NaN'), double(id * 7919 % 30011))) AS gaps",
        "if(id % 3 = 0, 'same', concat('t', id * 104729 % 30011)) AS text", "timestamp_seconds(1700000000 + id DIV 5) AS at",
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("sort", SORTS)
def test_deep_pages_are_those_of_a_full_sort(table, sort):
    order = paging.sort_keys(table, sort)
    whole = [r["id"] for r in paging._sorted(table, order).select("id").collect()]
    for offset in (0, 14_990, 27_000, 29_995, 31_000):
        got = [r["id"] for r in paging.page(table, order, offset, 25, shallow=300).collect()]
        assert got == whole[offset : offset + 25]


def test_a_deep_page_sorts_few_rows(table):
    order = paging.sort_keys(table, [("few", "desc"), ("gaps", "asc"), ("id", "asc")])
    around, before = paging._around(table, order, 27_000, 50, 3000)
    assert around.count() <= 3000 and before <= 27_000
    wide, _ = paging._around(table, paging.sort_keys(table, [("id", "asc")]), 27_000, 50, 3000)
    assert "GreaterThanOrEqual(id," in wide._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_end_the_search(spark):
    same = spark.range(5000).selectExpr("1 AS k", "id")
    assert paging.page(same, [F.col("k")], 4000, 10, shallow=100).count() == 10


def test_directions_of_columns_are_kept(table):
    got = paging.page(table, [F.col("id").desc()], 29_000, 5, shallow=100).collect()
    assert [r["id"] for r in got] == [999, 998, 997, 996, 995]


@pytest.mark.parametrize("sort", SORTS[2:6])
def test_ranked_pages_read_only_their_ranges(spark, table, tmp_path, sort):
    order, path = paging.sort_keys(table, sort), str(tmp_path / "ranked")
    paging.write_ranked(table, order, path, 500)
    whole = [r["id"] for r in paging._sorted(table, order).select("id").collect()]
    for offset in (0, 27_000, 29_990):
        got = paging.ranked_page(spark, path, order, offset, 40)
        assert [r["id"] for r in got.collect()] == whole[offset : offset + 40]
    assert paging.ranked_page(spark, path, order, 30_000, 40).count() == 0
    read = paging.ranked_page(spark, path, order, 27_000, 40)
    assert len({f for f in read.inputFiles()}) == 60 or "PartitionFilters: [isnotnull(_range" in read._jdf.queryExecution().executedPlan().toString()
    ranges = spark.read.parquet(f"{path}/ranges")
    assert ranges.agg(F.sum("rows")).first()[0] == 30_000 and ranges.count() > 20


def test_page_ends_are_counted_not_sorted(table):
    order = paging.sort_keys(table, [("id", "asc")])
    assert paging.page_with_more(table, order, 29_990, 10).first()["has_more"] is False
    assert paging.page_with_more(table, order, 29_989, 10).first()["has_more"] is True
    assert paging.token_page(table, order, "29990", 10).first()["next_token"] == "30000"
    assert paging.token_page(table, order, "29991", 10).first()["next_token"] is None
    text = paging.page_with_more(table, order, 100, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Sort [") == 1


def test_small_ranges_are_cut_within_few_tasks(spark, table, tmp_path):
    """Ranges are exact and as small as asked for, but tasks, whose cuts are drawn through the driver, are few."""
    order, path = paging.sort_keys(table, [("id", "desc")]), str(tmp_path / "small")
    paging.write_ranked(table, order, path, 100)
    ranges = spark.read.parquet(f"{path}/ranges")
    assert {r["rows"] for r in ranges.collect()} == {100}
    assert ranges.selectExpr(f"shiftright(_range, {paging.PLACE_BITS}) AS task").distinct().count() == 1
    read = paging.ranked_page(spark, path, order, 150, 100)
    assert [r["id"] for r in read.collect()] == list(range(29_849, 29_749, -1))
    assert len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 2
