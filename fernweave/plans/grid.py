"""Grid requests: filter, sort and page a table or one of its versions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators.paging import date_aware_keys, page
from fernweave.operators.predicates import grid_filter
from fernweave.sources.snapshots import read_snapshot


@dataclass(frozen=True)
class GridResult:
    """The columns, one page of rows and the number of rows behind the filter."""

    columns: list[str]
    rows: DataFrame
    total: DataFrame


def grid_query(df: DataFrame, request: dict, key: list[str]) -> GridResult:
    """Answer a ``{column_filters, logic, sort_by, sort_order, offset, limit}`` request.

    ``key`` completes the order, so pages neither repeat nor skip rows.  A request for more
    rows than a page may have raises; it is never answered in part.
    """
    filtered = grid_filter(df, request.get("column_filters") or [], request.get("logic", "AND"))
    order = [F.col(k) for k in key]
    if request.get("sort_by"):
        if request["sort_by"] not in df.columns:
            raise ValueError(f"unknown sort column {request['sort_by']!r}")
        order = [*date_aware_keys(df, request["sort_by"], request.get("sort_order", "asc")), *order]
    rows = page(filtered, order, request.get("offset", 0), request.get("limit", 1000))
    return GridResult(df.columns, rows, filtered.agg(F.count("*").alias("total")))


def versioned_grid_query(spark: SparkSession, path: str, request: dict, key: list[str]) -> GridResult:
    """The same over a stored table, at a version or a time when the request names one."""
    as_of = request.get("as_of_timestamp")
    when = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return grid_query(read_snapshot(spark, path, request.get("version"), when), request, key)
