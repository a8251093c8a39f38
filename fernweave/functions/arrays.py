"""Rows out of arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_array(df: DataFrame, keep: list[str], value: Column, name: str, position: str = "_position") -> DataFrame:
    """One row per element, with its position; the array is computed once per row.

    A plain ``explode`` makes Spark add a filter on the array's size, which computes a
    parsed or extracted array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(value).alias(position, name))
    rows = rows.where(F.col(position).isNotNull())
    return rows.drop(position) if position == "_position" else rows


def explode_map(df: DataFrame, keep: list[str], value: Column, key: str, name: str) -> DataFrame:
    """One row per map entry; the map is computed once per row."""
    return df.select(*keep, F.explode_outer(value).alias(key, name)).where(F.col(key).isNotNull())
