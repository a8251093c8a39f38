"""Relationship suggestions from all discovery methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators.semantics import discover_foreign_keys, discover_names
from fernweave.operators.sets import best_pairs, exclude_pairs

_PAIR = ["left_table_id", "left_column_id", "right_table_id", "right_column_id", "confidence"]


def suggest_relationships(
    tables: DataFrame,
    columns: DataFrame,
    existing: DataFrame | None = None,
    by_foreign_key: bool = True,
    by_name: bool = True,
    cross_connection: bool = True,
) -> DataFrame:
    """New column pairs with the method that found them, the best per unordered pair.

    ``existing``: left_column_id, right_column_id of relationships that are known.
    """
    found = []
    if by_foreign_key:
        found.append(discover_foreign_keys(columns).select(*_PAIR, F.lit("foreign_key").alias("source")))
    if by_name:
        found.append(discover_names(tables, columns, cross_connection).select(*_PAIR, F.lit("name").alias("source")))
    everything = reduce(DataFrame.unionByName, found)
    order = ["source", "left_column_id", "right_column_id"]
    best = best_pairs(everything, "left_column_id", "right_column_id", "confidence", order)
    return best if existing is None else exclude_pairs(best, existing, "left_column_id", "right_column_id")
