"""Bounded samples by hash, without bringing candidates of every task together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows let through by the hash for each row wanted, so that chance does not leave too few.
SURPLUS = 1.5

_SPAN = 1 << 30


def least_hashes(rows: DataFrame, key: Column, most: int, count: int) -> DataFrame:
    """The ``most`` rows with the least hashes of ``key``, all if there are fewer.

    ``count``, the number of rows, sets a bound on the hash that lets about half as many again
    through; only these are put in order.
    """
    draw = F.pmod(F.xxhash64(key), F.lit(_SPAN))
    near = rows if count <= most else rows.where(draw < F.lit(int(_SPAN * min(1.0, (SURPLUS * most + 100) / count))))
    return near.orderBy(draw, key).limit(most)
