"""Summaries of a column that are kept for each batch and merged: frequent values and distinct counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values tracked by a summary, and the logarithm of the distinct counter's registers.
TRACKED = 10_000
REGISTERS = 14


def summarise_values(df: DataFrame, column: str, groups: list[str] | None = None, tracked: int = TRACKED, registers: int = REGISTERS) -> DataFrame:
    """One small row for each group: rows with a value, their frequent values and distinct counter.

    NULLs are not counted, an empty group has no row.  The summaries are plain columns: write
    them beside a batch, and read those of many batches to merge them.
    """
    filled = df.where(F.col(column).isNotNull())
    value = F.col(column)
    counted = value if isinstance(df.schema[column].dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else value.cast("string")
    return filled.groupBy(*(groups or [])).agg(
        F.count("*").alias("n_values"),
        F.call_function("approx_top_k_accumulate", value, F.lit(tracked)).alias("frequent"),
        F.hll_sketch_agg(counted, registers).alias("distinct"),
    )


def merge_summaries(summaries: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Summaries of several batches as one for each group, as if all rows had come at once."""
    return summaries.groupBy(*(groups or [])).agg(
        F.sum("n_values").alias("n_values"),
        F.call_function("approx_top_k_combine", F.col("frequent")).alias("frequent"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def frequency_error(tracked: int = TRACKED) -> float:
    """The share of all values by which a reported count may be off at most.

    A summary of ``tracked`` values has a table of the next power of two above 4/3 of that; it
    is off by no more than 3.5 over its size.  While no more values than it tracks are
    distinct, counts are exact.
    """
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def frequent_values(summaries: DataFrame, k: int, groups: list[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    """(groups, value, count, may_be_off_by) of the ``k`` most frequent values of each summary."""
    groups = groups or []
    off = F.floor(F.col("n_values") * F.lit(frequency_error(tracked)))
    exact = F.hll_sketch_estimate("distinct") * F.lit(1.1) <= tracked  # far from full, also by the counter's own error
    found = summaries.select(
        *groups, F.when(exact, F.lit(0)).otherwise(off).cast("bigint").alias("may_be_off_by"),
        F.explode(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k))).alias("_v"),
    )
    return found.select(*groups, F.col("_v.item").alias("value"), F.col("_v.count").alias("count"), "may_be_off_by")


def distinct_estimates(summaries: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, n_values, n_distinct) of each summary; the counter's standard error is 1.04 / 2^(registers / 2)."""
    return summaries.select(*(groups or []), "n_values", F.hll_sketch_estimate("distinct").alias("n_distinct"))
