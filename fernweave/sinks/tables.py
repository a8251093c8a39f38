"""Appends, exports, manifests, registration and the execution log."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.functions.coerce import serialise
from fernweave.functions.paths import safe_name
from fernweave.session import clock, path_exists
from fernweave.sinks.snapshots import sized

EXECUTION_SCHEMA = (
    "id bigint, config_id bigint, status string, started_at timestamp, finished_at timestamp, rows_processed bigint, "
    "rows_output bigint, version bigint, paths array<string>, config string, error string"
)


def append_batch(
    df: DataFrame, path: str, dataset_id: int, batch_id: int, as_text: bool = False, at: dt.datetime | None = None
) -> None:
    """Append rows with dataset, time and batch stamps; ``as_text`` stores every column as text."""
    if as_text:
        df = df.select(*[serialise(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    stamped = df.withColumns(
        {"_dataset_id": F.lit(dataset_id), "_extraction_timestamp": clock(at), "_batch_id": F.lit(batch_id)}
    )
    stamped.write.mode("append").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches; columns that only some batches have are NULL elsewhere."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: list[str]) -> None:
    """One folder per value; a hot value is split over several files."""
    sized(df, columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def flat_for_export(df: DataFrame) -> DataFrame:
    """Nested and binary columns as text, everything else as it is."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)
    return df.select(
        *[
            serialise(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def export(df: DataFrame, path: str, form: str) -> None:
    """Write CSV with a header, or one JSON object per line."""
    writer = flat_for_export(df).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form in ("json", "ndjson"):
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export form {form!r}")


def write_manifest(df: DataFrame, key: str, path: str, stamp: str, filters: dict) -> None:
    """A dataset's manifest: stamp, filters and count in one row, its ids as a table beside it."""
    ids = df.select(F.col(key).alias("id"))
    sized(ids).write.mode("overwrite").parquet(f"{path}/ids")
    manifest = df.sparkSession.read.parquet(f"{path}/ids").agg(F.count("*").alias("count")).select(
        F.lit(stamp).alias("stamp"), "count", F.lit(json.dumps(filters)).alias("filters"), F.lit(f"{path}/ids").alias("ids")
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the manifest row, the ids)."""
    row = spark.read.schema("stamp string, count bigint, filters string, ids string").json(f"{path}/manifest")
    return row, spark.read.parquet(f"{path}/ids")


def register_view(df: DataFrame, config_id: int, name: str) -> str:
    """Make a result queryable as ``{id}_{name}``; replaces an earlier one."""
    view = f"{config_id}_{safe_name(name)}".replace("-", "_")
    df.createOrReplaceTempView(f"`{view}`")
    return view


def register_location(spark: SparkSession, config_id: int, name: str, path: str) -> str:
    """Make a stored Parquet folder queryable as a table; replaces an earlier one."""
    table = f"t{config_id}_{safe_name(name)}".replace("-", "_")
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    escaped = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE `{table}` USING parquet LOCATION '{escaped}'")
    return table


def next_execution(log: DataFrame, config_id: int) -> dict[str, int]:
    """Id and version the next execution of a configuration gets."""
    row = log.agg(
        F.coalesce(F.max("id") + 1, F.lit(1)).alias("id"),
        F.coalesce(F.max(F.when(F.col("config_id") == config_id, F.col("version"))) + 1, F.lit(0)).alias("version"),
    ).first()
    return row.asDict()


def run_groups(groups: dict[str, Callable[[], str]], at_once: int = 3) -> dict[str, dict]:
    """Run independent writes, a few at once; a failed one does not stop the others."""
    def run(write: Callable[[], str]) -> dict:
        try:
            return {"status": "success", "path": write(), "error": None}
        except Exception as error:  # noqa: BLE001 - the status row carries any failure
            return {"status": "failed", "path": None, "error": str(error)}

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(groups, pool.map(run, groups.values()), strict=True))


def overall_status(outcome: dict[str, dict]) -> str:
    states = {o["status"] for o in outcome.values()}
    return states.pop() if len(states) == 1 else "partial"


def log_execution(
    spark: SparkSession,
    path: str,
    config_id: int,
    outcome: dict[str, dict],
    started_at: dt.datetime,
    rows_processed: int | None,
    rows_output: int | None,
    config: dict,
) -> None:
    """Append one execution with its configuration; versions count from 0 per configuration."""
    log = spark.createDataFrame([], EXECUTION_SCHEMA)
    if path_exists(spark, path):
        log = spark.read.schema(EXECUTION_SCHEMA).parquet(path)
    nxt = next_execution(log, config_id)
    paths = sorted(o["path"] for o in outcome.values() if o["path"])
    errors = "; ".join(f"{n}: {o['error']}" for n, o in outcome.items() if o["error"]) or None
    row = (
        nxt["id"], config_id, overall_status(outcome), started_at, dt.datetime.now(dt.timezone.utc), rows_processed,
        rows_output, nxt["version"], paths, json.dumps(config, sort_keys=True), errors,
    )
    spark.createDataFrame([row], EXECUTION_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def known_paths(log: DataFrame) -> DataFrame:
    """Every path any execution wrote."""
    return log.select(F.explode("paths").alias("path")).distinct()


def tagged_metadata(datasets: DataFrame, columns: DataFrame, sources: DataFrame) -> DataFrame:
    """Dataset, column and source records in one table told apart by ``record_type``; absent fields NULL."""
    tagged = [
        df.select(F.lit(kind).alias("record_type"), *df.columns)
        for kind, df in (("dataset", datasets), ("column", columns), ("source", sources))
    ]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True).unionByName(tagged[2], allowMissingColumns=True)


def record_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("record_type").agg(F.count("*").alias("count"))


def validate_export(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """One row about a stored export: valid, row count, record types, errors and warnings.

    An export that is not there is an error; an empty one or a missing manifest a warning.
    """
    if not path_exists(spark, path):
        nothing = spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("string").alias("record_types"))
        return nothing.select(
            F.lit(False).alias("valid"), "row_count", "record_types", F.lit(f"cannot read {path}").alias("errors"), F.lit("").alias("warnings")
        )
    found = spark.read.parquet(path).agg(
        F.count("*").alias("row_count"), F.array_join(F.array_sort(F.collect_set("record_type")), ",").alias("record_types")
    )
    missing = not path_exists(spark, manifest)
    warnings = F.array_compact(
        F.array(F.when(F.col("row_count") == 0, F.lit("table is empty")), F.when(F.lit(missing), F.lit("manifest missing")))
    )
    return found.select(
        F.lit(True).alias("valid"), "row_count", "record_types", F.lit("").alias("errors"), F.array_join(warnings, "; ").alias("warnings")
    )
