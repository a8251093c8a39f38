"""Sorting and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators import aggregates, paging
from fernweave.plans import grid
from fernweave.queries.registry import Tables, query
from fernweave.sinks.snapshots import write_snapshot


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")
def filtered_total(t: Tables) -> DataFrame:
    return aggregates.total_count(t.orders.where("o_totalprice > 100000"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 200 LIMIT 100")
def offset_page(t: Tables) -> DataFrame:
    return paging.page(t.orders, paging.sort_keys(t.orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")]), 200, 100)


_DEEP = """
SELECT * FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) BETWEEN (SELECT count(*) * 9 // 10 + 1 FROM orders) AND (SELECT count(*) * 9 // 10 + 100 FROM orders)
"""


@query(_DEEP)
def deep_page(t: Tables) -> DataFrame:
    """A page at nine tenths of the table, from the rows around it only."""
    order = paging.sort_keys(t.orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")])
    return paging.page(t.orders, order, t.orders.count() * 9 // 10, 100, shallow=2000)


@query(_DEEP)
def ranked_page(t: Tables) -> DataFrame:
    """The same page from a table kept in ranges of the order."""
    order = paging.sort_keys(t.orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")])
    paging.write_ranked(t.orders, order, path := t.scratch("ranked"), 1000)
    return paging.ranked_page(t.spark, path, order, t.orders.count() * 9 // 10, 100)


@query("SELECT * FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 100")
def keyset_page(t: Tables) -> DataFrame:
    return paging.page_after(t.orders, "o_orderkey", 300, 100)


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 50")
def date_sorted_page(t: Tables) -> DataFrame:
    """Dates held as text sort by date, not by their letters."""
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    return paging.page(df, [*paging.date_aware_keys(df, "day", "desc"), F.col("o_orderkey")], 0, 50)


@query("""
SELECT *, (SELECT count(*) FROM part) AS total_rows, (SELECT ceil(count(*) / 25)::BIGINT FROM part) AS total_pages FROM part
ORDER BY p_type, p_retailprice DESC, p_partkey OFFSET 50 LIMIT 25
""")
def numbered_page(t: Tables) -> DataFrame:
    return paging.numbered_page(t.part, [("p_type", "asc"), ("p_retailprice", "desc"), ("p_partkey", "asc")], 3, 25)


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) > 120 FROM orders) AS has_more FROM orders ORDER BY o_orderkey OFFSET 100 LIMIT 20")
def page_with_more(t: Tables) -> DataFrame:
    return paging.page_with_more(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 100, 20)


@query("SELECT p_partkey, p_name, '60' AS next_token FROM part ORDER BY p_name, p_partkey OFFSET 40 LIMIT 20")
def token_page(t: Tables) -> DataFrame:
    return paging.token_page(t.part.select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], "40", 20)


@query("""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) <= 3
""")
def first_rows_per_group(t: Tables) -> DataFrame:
    return paging.first_rows(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], 3)


@query("""
SELECT event_id, ts, user_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS version FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5
""")
def newest_history(t: Tables) -> DataFrame:
    return paging.history(t.events, "user_id", ["ts", "event_id"], 5)


_GRID = {
    "version": 0,
    "column_filters": [{"column": "day", "operator": "gte", "value": "1998-01-01"}, {"column": "o_orderpriority", "operator": "contains", "value": "high"}],
    "sort_by": "day",
    "sort_order": "desc",
    "offset": 10,
    "limit": 40,
}
_GRID_ROWS = """SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-01' AND o_orderpriority ILIKE '%high%'"""


def _grid(t: Tables) -> grid.GridResult:
    path = t.scratch("grid")
    df = t.orders.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    write_snapshot(df, path)
    write_snapshot(df.where("o_orderkey < 0"), path)
    return grid.versioned_grid_query(t.spark, path, _GRID, ["o_orderkey"])


@query(f"{_GRID_ROWS} ORDER BY o_orderdate::DATE DESC, o_orderkey OFFSET 10 LIMIT 40")
def grid_request(t: Tables) -> DataFrame:
    """One grid request over an old version: date-aware filter and sort, one page."""
    return _grid(t).rows


@query(f"SELECT count(*) AS total FROM ({_GRID_ROWS})")
def grid_request_total(t: Tables) -> DataFrame:
    return _grid(t).total
