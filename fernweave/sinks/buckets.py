"""Tables in hash buckets, of which an upsert rewrites only those that its keys fall in.

The bucket is a partition column, and Spark's dynamic partition overwrite replaces the
touched buckets.  The number of buckets is part of the folder names and fixed with the first
write.  Such a table has one state and no versions; for time travel write snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators.sets import keep_last
from fernweave.session import matching_names
from fernweave.sinks.snapshots import check_keys

BUCKETS = 64

#: Buckets that one upsert names in its scan at most; a batch that touches more reads all.
NAMED = 1000


def _bucket(df: DataFrame, keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    placed = df.withColumns({"_buckets": F.lit(buckets), "_bucket": _bucket(df, keys, buckets)})
    writer = placed.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("_buckets", "_bucket").parquet(path)


def is_bucketed(spark: SparkSession, path: str) -> bool:
    """Whether anything was ever written."""
    return bool(matching_names(spark, f"{path}/_buckets=*/_bucket=*"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a bucketed table; columns added later are NULL in older rows."""
    return _stored(spark, path).drop("_buckets", "_bucket")


def upsert_buckets(df: DataFrame, path: str, keys: list[str], sequence: list[str] | None = None, buckets: int = BUCKETS) -> list[int]:
    """Update rows with a known key and insert the others, rewriting the touched buckets only; returns these.

    Several rows of one key, also a stored and a new one, are ordered by ``sequence``, the
    last wins; without it new rows win and keys may not repeat.  NULL keys raise.  A column
    the batch lacks keeps its value, a new one is added.  Keys take the stored types.  The
    number of buckets holds for the first write; an empty one leaves no table.  A writer that dies leaves the old rows or
    the new ones in each bucket, and the same upsert may be run again.  Upserts of one table
    must follow each other.
    """
    spark = df.sparkSession
    check_keys(df, keys, repeated=sequence is None)
    fresh = keep_last(df, keys, sequence) if sequence else df
    if not is_bucketed(spark, path):
        if fresh.isEmpty():
            return []
        _write(fresh, path, keys, buckets)
        return sorted(r[0] for r in _stored(spark, path).select("_bucket").distinct().collect())
    table = _stored(spark, path)
    buckets = table.select("_buckets").first()[0]
    fresh = fresh.withColumns({k: F.col(f"`{k}`").cast(table.schema[k].dataType) for k in keys})
    touched = sorted(r[0] for r in fresh.select(_bucket(fresh, keys, buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    old = (table.where(F.col("_bucket").isin(touched)) if len(touched) <= NAMED else table).drop("_buckets", "_bucket")
    new = fresh
    if sequence:
        stale = old.select(*keys, F.struct(*sequence).alias("_held"))
        later = F.coalesce(F.struct(*sequence) >= F.col("_held"), F.lit(True))
        new = fresh.join(stale, keys, "left").where(later).drop("_held")
    kept = old.join(new.select(*keys), keys, "left_anti")
    lacking = [c for c in old.columns if c not in new.columns]
    if lacking:
        new = new.join(old.select(*keys, *lacking), keys, "left")
    _write(new.unionByName(kept, allowMissingColumns=True), path, keys, buckets)
    return touched
