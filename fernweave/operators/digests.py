"""Comparing two tables by digests of key buckets, so that only buckets with differences are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of keys.  Bounds what is broadcast: one number for each bucket that differs.
BUCKETS = 1 << 16

LOW_HALF = 0xFFFFFFFF


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))


def _row_hash(df: DataFrame, columns: list[str], salt: int) -> Column:
    """A hash of a row; a NULL is told from a value missing beside it, maps are read as text."""
    parts: list[Column] = [F.lit(salt)]
    for name in columns:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.MapType):
            value = F.to_json(value)
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def bucket_digests(df: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_rows, digest) of the rows with a key: the same for the same rows in any order.

    The digest joins two independent 64-bit hashes of each row, one added up by halves (so
    that no sum overflows below two thousand million rows of a bucket), one by exclusive or.
    It is a plain partial aggregate: no more than ``buckets`` rows of a partition are shuffled.
    """
    hashed = df.where(F.col(key).isNotNull()).select(
        _bucket(key, buckets).alias("bucket"), _row_hash(df, [key, *columns], 1).alias("_a"), _row_hash(df, [key, *columns], 2).alias("_b")
    )
    return hashed.groupBy("bucket").agg(
        F.count("*").alias("n_rows"),
        F.struct(
            F.sum(F.col("_a").bitwiseAND(LOW_HALF)).alias("low"), F.sum(F.shiftrightunsigned("_a", 32)).alias("high"), F.bit_xor("_b").alias("mixed")
        ).alias("digest"),
    )


def differing_buckets(old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket) of the key buckets whose rows are not the same in both tables."""
    sides = [bucket_digests(df, key, columns, buckets).withColumnsRenamed({"n_rows": f"n_{s}", "digest": f"digest_{s}"}) for s, df in (("old", old), ("new", new))]
    both = sides[0].join(sides[1], "bucket", "full")
    same = F.col("n_old").eqNullSafe(F.col("n_new")) & F.col("digest_old").eqNullSafe(F.col("digest_new"))
    return both.where(~same).select("bucket")


def differing_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables that lie in buckets with differences, and those without a key.

    Either table is read twice: once for its digests, which shuffles no rows, and once with a
    broadcast of the differing bucket numbers, at most ``buckets`` of them.  A row that is left
    out has its like in the other table, so comparing what is left gives the same differences.
    Keys are taken to be unique; repeated ones are compared as a bag of rows.
    """
    changed = differing_buckets(old, new, key, columns, buckets)

    def kept(df: DataFrame) -> DataFrame:
        here = df.where(F.col(key).isNotNull()).join(F.broadcast(changed), _bucket(key, buckets) == F.col("bucket"), "left_semi")
        return here.unionByName(df.where(F.col(key).isNull()))

    return kept(old), kept(new)
