"""Put records into weighted shards by rendezvous hashing, and number them without gaps.

Every shard draws a score for every key from the key and its own number alone; the shard
with the best score takes the record.  A further shard can only win records for itself, so
growing from n to n + 1 equal shards moves about 1 / (n + 1) of them and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13

#: Parts into which a shard's records are dealt for numbering; a power of 16.
NUMBERING_DIGITS = 3


def _draw(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("bigint")


def _key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def scores(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Array of (cost, shard), one for each weight; the least cost takes the key."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("shards need positive weights")
    text, span = _key_text(key), float(16**DRAW_DIGITS)

    def cost(shard: int, weight: float) -> Column:
        draw = _draw(F.concat(text, F.lit(f"#{shard}")))
        return F.struct((-F.ln((draw + F.lit(0.5)) / F.lit(span)) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    return F.array(*(cost(first + i, w) for i, w in enumerate(weights)))


def assign_shards(docs: DataFrame, weights: Sequence[float], key_col: str = "doc_id", shard_col: str = "shard", grown_col: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add the shard of each row, and with ``grown_col`` its shard once one more shard is there.

    Key and shard count decide and nothing else, so equal keys share a shard; NULL keys are
    one key of their own.  Rows stand alone, no shuffle.  An empty table stays empty.
    Columns of the chosen names are replaced.
    """
    best = F.array_min(scores(F.col(key_col), weights))
    if grown_col is None:
        return docs.withColumn(shard_col, best["shard"])
    held = docs.withColumn("__fw_best", best).withColumn(shard_col, F.col("__fw_best")["shard"])
    late = scores(F.col(key_col), [grown_weight], first=len(weights))[0]
    return held.withColumn(grown_col, F.least(F.col("__fw_best"), late)["shard"]).drop("__fw_best")


def number_rows(rows: DataFrame, group_col: str, key_col: str, order: Sequence[str], slot_col: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in parts that any number of tasks can share.

    A group's rows are dealt into 4096 parts by their key's digest; the parts are numbered
    by running totals of their counts, and the rows inside a part by ``order``.  Rows equal
    in all of ``order`` may swap numbers among themselves.
    """
    part = F.substring(F.md5(_key_text(F.col(key_col))), 1, NUMBERING_DIGITS)
    dealt = rows.withColumn("__fw_part", part)
    ahead = Window.partitionBy(group_col).orderBy("__fw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(group_col, "__fw_part").count().select(
        group_col, "__fw_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__fw_ahead")
    )
    inside = F.row_number().over(Window.partitionBy(group_col, "__fw_part").orderBy(*order))
    numbered = dealt.join(offsets, [group_col, "__fw_part"])
    return numbered.withColumn(slot_col, (F.col("__fw_ahead") + inside - 1).cast("bigint")).drop("__fw_part", "__fw_ahead")
