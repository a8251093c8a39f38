"""Sorting and pages.

Every page needs a total order, so each function takes tiebreak columns.  A page near the
start is a top-k per partition (``orderBy().offset().limit()``), never a numbered global
sort.  A deep page first narrows the table to the rows around it: cuts drawn closely around
the offset, and counts of the rows before and between them.  For many deep pages of one table
:func:`write_ranked` keeps it in ranges of the order with running totals, so that a page
reads and sorts only the ranges that hold it.  :func:`page_after` costs the same at any depth.
"""

from __future__ import annotations

import math
import operator
import random
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.functions.dates import as_date, detect_date_formats
from fernweave.operators.ranking import LIMITED_BY_SPARK, first_per_key

MAX_PAGE = 100_000
DELIVERY_CAP = 50_000

#: Rows up to which a page is a top-k, and rows drawn to find the cuts around a deeper one.
SHALLOW = 200_000
SAMPLE = 4000

#: Rows in a range of a ranked table, and in a task that writes one, at least.
RANGE_ROWS = 100_000

#: Bits that Spark's growing ids have for a row's place in its task.
PLACE_BITS = 33


@dataclass(frozen=True)
class Key:
    """A value to sort by; NULL counts as the least value in either direction."""

    value: Column
    descending: bool = False

    def column(self) -> Column:
        return self.value.desc_nulls_last() if self.descending else self.value.asc_nulls_first()

    def before(self, cut: object, kind: T.DataType) -> Column:
        """Whether a row's value comes strictly before the cut's."""
        if cut is None:
            return self.value.isNotNull() if self.descending else F.lit(False)
        literal = F.lit(cut).cast(kind)
        return F.coalesce(self.value > literal if self.descending else self.value < literal, F.lit(not self.descending))

    def bound(self, cut: object, kind: T.DataType, upper: bool) -> Column | None:
        """A plain comparison that rows up to (or from) the cut meet, which scans can use; None if NULLs are in question."""
        if cut is None or upper != self.descending:
            return None
        return self.value >= F.lit(cut).cast(kind)


def _keys(order: list[Column | Key]) -> list[Key] | None:
    """The order as keys, None if a column states a direction of its own."""
    own = any(not isinstance(k, Key) and re.search(r" (ASC|DESC) NULLS (FIRST|LAST)'>$", str(k)) for k in order)
    return None if own else [k if isinstance(k, Key) else Key(k) for k in order]


def _sorted(df: DataFrame, order: list[Column | Key]) -> DataFrame:
    return df.orderBy(*(k.column() if isinstance(k, Key) else k for k in order))


def sort_keys(df: DataFrame, sort: list[tuple[str, str]], formats: dict[str, str] | None = None) -> list[Key]:
    """Keys to sort by; date columns, and text columns in ``formats``, sort by date."""
    keys = []
    for name, direction in sort:
        if name not in df.columns:
            raise ValueError(f"unknown sort column {name!r}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"unknown sort direction {direction!r}")
        date = as_date(name, df.schema[name].dataType, formats) if formats is not None else None
        keys.append(Key(F.col(f"`{name}`") if date is None else date, direction == "desc"))
    return keys


def date_aware_keys(df: DataFrame, column: str, direction: str = "asc") -> list[Key]:
    """Sort key for one column after looking whether it holds dates as text."""
    text = dict(df.dtypes)[column] == "string"
    return sort_keys(df, [(column, direction)], detect_date_formats(df, [column]) if text else {})


def _around(df: DataFrame, keys: list[Key], offset: int, limit: int, most: int) -> tuple[DataFrame, int]:
    """The rows around a page, about ``most`` at most, and the number of rows before them.

    Every pass draws a bounded sample of the rows in question, takes as cuts two drawn rows
    closely around the page, and counts the rows before the first and up to the second.  Rows
    with equal keys are not parted, so ties only make a pass end sooner.
    """
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [f.dataType for f in df.select(*(k.value.alias(n) for k, n in zip(keys, names))).schema]

    def before(cut: tuple, also_equal: bool) -> Column:
        out, equal = F.lit(False), F.lit(True)
        for key, value, kind in zip(keys, cut, kinds):
            out = out | equal & key.before(value, kind)
            equal = equal & key.value.eqNullSafe(F.lit(value).cast(kind))
        return out | equal if also_equal else out

    rows, skipped, draw = df, 0, random.Random(0)
    inside = df.count()
    if offset >= inside:
        return df.limit(0), offset
    while inside > most:
        share = min(1.0, SAMPLE / inside)
        drawn = rows.select(*(k.value.alias(n) for k, n in zip(keys, names))).where(F.rand(draw.getrandbits(30)) < share)
        cuts = [tuple(r) for r in drawn.orderBy(*(Key(F.col(n), k.descending).column() for k, n in zip(keys, names))).collect()]
        if not cuts:
            continue
        spread = 3 * math.sqrt(len(cuts)) + 2
        low, high = ((at - skipped) / inside * len(cuts) for at in (offset, offset + limit))
        first, last = cuts[max(0, min(len(cuts) - 1, int(low - spread)))], cuts[min(len(cuts) - 1, int(high + spread))]
        conditions = [] if low < spread else [~before(first, False)]
        conditions += [] if high + spread >= len(cuts) else [before(last, True)]
        if not conditions:
            break
        kept = rows.where(reduce(operator.and_, conditions))
        for cut, upper, used in ((first, False, low >= spread), (last, True, high + spread < len(cuts))):
            plain = keys[0].bound(cut[0], kinds[0], upper) if used else None
            kept = kept if plain is None else kept.where(plain)
        under = rows.agg(F.count_if(before(first, False))).first()[0] if low >= spread else 0
        size = kept.count()
        hit = skipped + under <= offset and (offset + limit <= skipped + under + size or high + spread >= len(cuts))
        if not hit:  # a rare draw: the page is not between the cuts
            continue
        settled = size > 0.9 * inside  # equal rows
        rows, skipped, inside = kept, skipped + under, size
        if settled:
            break
    return rows, skipped


def page(df: DataFrame, order: list[Column | Key], offset: int = 0, limit: int = 1000, shallow: int = SHALLOW) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given total order.

    Beyond ``shallow`` rows the table is read a few times to find the rows around the page;
    an order given by columns with a direction of their own is then sorted as a whole.
    """
    if offset < 0 or not 0 < limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative and limit must be 1 to {MAX_PAGE}")
    return _page(df, order, offset, limit, shallow)


def _page(df: DataFrame, order: list[Column | Key], offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    keys = _keys(order)
    if offset + limit > shallow and keys:
        df, before = _around(df, keys, offset, limit, shallow)
        offset -= before
    return _sorted(df, order).offset(offset).limit(limit)


def write_ranked(df: DataFrame, order: list[Column | Key], path: str, range_rows: int | None = None) -> None:
    """Keep a table in ranges of an order, with each range's rows and the rows before it, for :func:`ranked_page`.

    Spark deals the rows to tasks at quantiles of a sample, ``RANGE_ROWS`` or more to each
    however small the ranges are, since what it draws for that goes through the driver.
    A task sorts its rows and cuts them into ranges by their place.
    """
    rows, most = df.count(), range_rows or RANGE_ROWS
    columns = [k.column() if isinstance(k, Key) else k for k in order]
    ranged = df.repartitionByRange(max(1, math.ceil(rows / max(most, RANGE_ROWS))), *columns).sortWithinPartitions(*columns)
    placed = ranged.withColumn("_range", F.monotonically_increasing_id())  # the task's number in the upper bits, the row's place below
    task = f"shiftleft(shiftright(_range, {PLACE_BITS}), {PLACE_BITS})"
    placed.withColumn("_range", F.expr(f"{task} + (_range - {task}) div {most}")).write.partitionBy("_range").parquet(f"{path}/rows")
    counted = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("_range", T.LongType())])).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("_range")) - F.col("rows")  # one small row for each range
    counted.withColumn("before", before).write.parquet(f"{path}/ranges")


def ranked_page(spark: SparkSession, path: str, order: list[Column | Key], offset: int, limit: int) -> DataFrame:
    """A page of a ranked table, in the order it was written with; only the ranges that hold it are listed, read and sorted."""
    if offset < 0 or not 0 < limit <= MAX_PAGE:
        raise ValueError(f"offset must not be negative and limit must be 1 to {MAX_PAGE}")
    ranges = spark.read.parquet(f"{path}/ranges")
    holding = ranges.where((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)).orderBy("_range").collect()  # no more than the page's rows
    known = holding or ranges.limit(1).collect()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/_range={r['_range']}" for r in known)) if known else spark.read.parquet(f"{path}/rows")
    if not holding:
        return rows.drop("_range").limit(0)
    kept = rows.where(F.col("_range").between(holding[0]["_range"], holding[-1]["_range"])).drop("_range")
    return _sorted(kept, order).offset(offset - holding[0]["before"]).limit(limit)


def page_after(df: DataFrame, key: str, after: object = None, limit: int = 1000) -> DataFrame:
    """The next rows by a unique key; the filter reaches the scan."""
    return page(df if after is None else df.where(F.col(key) > F.lit(after)), [F.col(key)], 0, limit)


def numbered_page(df: DataFrame, sort: list[tuple[str, str]], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the total number of rows and pages beside each row."""
    total = df.agg(F.count("*")).scalar()
    rows = page(df, sort_keys(df, sort), (number - 1) * size, size)
    return rows.withColumns({"total_rows": total, "total_pages": F.ceil(total / F.lit(size)).cast("bigint")})


def total_pages(rows: int, size: int) -> int:
    return math.ceil(rows / size)


def page_with_more(df: DataFrame, order: list[Column | Key], offset: int, limit: int, cap: int = DELIVERY_CAP) -> DataFrame:
    """A delivery page with ``has_more``: is there a row behind it.  More than ``cap`` rows at once raise."""
    if offset < 0 or not 0 < limit <= cap:
        raise ValueError(f"offset must not be negative and limit must be 1 to {cap}")
    behind = df.agg(F.count("*") > offset + limit).scalar()
    return _page(df, order, offset, limit).withColumn("has_more", behind)


def token_page(df: DataFrame, order: list[Column | Key], token: str | None, size: int) -> DataFrame:
    """A page by offset token; ``next_token`` only when the page is full."""
    start = int(token or 0)
    full = df.agg(F.count("*") >= start + size).scalar()
    return _page(df, order, start, size).withColumn("next_token", F.when(full, F.lit(str(start + size))))


def first_rows(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group."""
    return first_per_key(df, group, [F.col(c) for c in order], n)


def history(df: DataFrame, key: str, sequence: list[str], n: int) -> DataFrame:
    """Each key's newest ``n`` entries with their position in its history, counting from 0.

    Positions come from the key's total, so only the newest entries are ever sorted.
    """
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_total"))
    newest = first_rows_desc(df, key, sequence, n)
    joined = newest.join(totals, F.col(key) == F.col("_key"))
    return joined.withColumn("version", F.col("_total") - F.col("_from_end")).drop("_key", "_total", "_from_end")


def first_rows_desc(df: DataFrame, key: str, sequence: list[str], n: int) -> DataFrame:
    """Each key's last ``n`` rows, numbered from the end (``_from_end``)."""
    newest_first = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in sequence])
    if n > LIMITED_BY_SPARK:
        df = first_per_key(df, [key], [F.col(c).desc() for c in sequence], n)
    return df.withColumn("_from_end", F.row_number().over(newest_first)).where(F.col("_from_end") <= n)
