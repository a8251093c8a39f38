"""Versioned tables: whole snapshots of Parquet with a small commit table.

Every write has a folder of its own below ``path/_data/``, and ``path/_commits/`` one row
per finished write, which names it.
Data is written first and its commit row last, so a write that dies leaves a folder no
reader looks at.  Writers may overlap: each has a version of its own, the highest finished
one is the latest.  Upserts build on the version they read, so those of one table must
follow each other.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.session import path_exists

COMMIT_SCHEMA = (
    "version bigint, committed_at timestamp, operation string, rows bigint, files bigint, bytes bigint, schema string, "
    "config string, folder string"
)


@dataclass(frozen=True)
class Commit:
    version: int
    rows: int
    files: int
    bytes: int


class VersionNotFound(ValueError):
    pass


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit table; empty when nothing was written yet."""
    log = f"{path}/_commits"
    if not path_exists(spark, log):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").parquet(log)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Versions that can be read, with their time and folder: written and not expired."""
    expired = F.col("operation") == "expire"
    written = F.max(F.when(~expired, F.struct("committed_at", "folder"))).alias("last")
    versions = commits(spark, path).groupBy("version").agg(F.bool_or(expired).alias("gone"), written)
    return versions.where("NOT gone").select("version", "last.*")


def _found(spark: SparkSession, path: str, version: int | None, as_of: dt.datetime | None, pinned: int | None) -> tuple[int, str]:
    live = _live(spark, path)
    wanted = pinned if pinned is not None else version
    if wanted is not None:
        live = live.where(F.col("version") == wanted)
    elif as_of is not None:
        live = live.where(F.col("committed_at") <= F.lit(as_of))
    found = live.agg(F.max(F.struct("version", "folder")).alias("f")).first()["f"]
    if found is None:
        raise VersionNotFound(f"{path}: no readable version for version={wanted} as_of={as_of}")
    return found["version"], found["folder"]


def resolve_version(
    spark: SparkSession, path: str, version: int | None = None, as_of: dt.datetime | None = None, pinned: int | None = None
) -> int:
    """The version a read means: a pin wins over the requested one, that over the latest."""
    return _found(spark, path, version, as_of, pinned)[0]


def read_snapshot(
    spark: SparkSession, path: str, version: int | None = None, as_of: dt.datetime | None = None, pinned: int | None = None
) -> DataFrame:
    """Latest snapshot, a given version, or the one current at a time."""
    return spark.read.parquet(f"{path}/{_found(spark, path, version, as_of, pinned)[1]}")


def history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Commits, newest first; all, or the newest ``limit``."""
    newest = commits(spark, path).orderBy(F.col("committed_at").desc(), F.col("version").desc())
    return newest if limit is None else newest.limit(limit)


def table_schema(df: DataFrame) -> dict:
    """The schema as JSON: fields with name, type, nullability and metadata."""
    return json.loads(df.schema.json())
