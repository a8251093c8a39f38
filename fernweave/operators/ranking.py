"""The first rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this many rows per key Spark itself limits each input partition (its default setting).
LIMITED_BY_SPARK = 1000
#: Rows of one key in a salted part, about.
PART_ROWS = 1_000_000


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.

    Spark limits each key to ``n`` rows within every input partition before it shuffles
    (window group limit), so a hot key never arrives whole at one task.  It does not for
    a large ``n``; then every key is first limited in salted parts, as many as the largest
    key's count asks for.
    """
    def limited(rows: DataFrame, parts: list[str | Column]) -> DataFrame:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
        return ranked.where(F.col("_rank") <= n).drop("_rank")

    if n > LIMITED_BY_SPARK:
        names = [F.col(k) if isinstance(k, str) else k for k in keys]
        largest = df.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
        salts = max(1, -(-largest // max(PART_ROWS, n)))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        df = limited(salted, [*keys, "_salt"]).drop("_salt")
    return limited(df, keys)
