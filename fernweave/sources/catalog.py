"""What tables there are, their columns, keys and first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators.semantics import column_keys

PREVIEW_CAP = 100


def table_catalog(frames: dict[str, DataFrame], schema: str = "default") -> DataFrame:
    """Name, type and row count of each table, in one plan (a count reads no column)."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), F.lit("table").alias("table_type"), "row_count"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def column_catalog(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Name, type, nullability and position of each column, from the schemas alone."""
    rows = [
        (table, f.name, f.dataType.simpleString(), f.nullable, position)
        for table, df in frames.items()
        for position, f in enumerate(df.schema, 1)
    ]
    ddl = "table_name string, column_name string, data_type string, is_nullable boolean, column_position int"
    return spark.createDataFrame(rows, ddl)


def merge_catalog(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalog after a new extraction: fresh entries replace those of the same table and column."""
    kept = existing.join(fresh.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    return fresh.unionByName(kept)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows by key; more than a hundred raise."""
    if not 0 < n <= PREVIEW_CAP:
        raise ValueError(f"a preview has 1 to {PREVIEW_CAP} rows")
    return df.orderBy(*order).limit(n)


def extract(frames: dict[str, DataFrame], columns: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """Several tables as one extract; a table may be limited to its first rows by key.

    ``columns`` names, per table by position, key first: every frame is read as given.
    """
    parts = []
    for name, df in frames.items():
        renamed = df.toDF(*columns)
        if limits and name in limits:
            renamed = renamed.orderBy(columns[0]).limit(limits[name])
        parts.append(renamed.select(F.lit(name).alias("source_table"), *columns))
    return reduce(DataFrame.unionByName, parts)


def key_constraints(frames: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """Keys the data supports: a column that is filled and unique, and columns contained in one.

    Result: table_name, column_name, constraint_type, ref_table, ref_column.  All columns
    share one distinct shuffle.
    """
    values = column_keys(frames, columns, totals=True)
    per_column = values.groupBy("table_name", "column_name").agg(
        F.count("value").alias("n_distinct"), F.max("row_count").alias("row_count")
    )
    # every row has its own value exactly when there are as many distinct values as rows
    unique = per_column.where("n_distinct = row_count")
    primary = unique.select(
        "table_name", "column_name", F.lit("PRIMARY KEY").alias("constraint_type"),
        F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_column"),
    )
    targets = values.join(unique.select("table_name", "column_name"), ["table_name", "column_name"]).select(
        F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "value"
    )
    hits = values.select("table_name", "column_name", "value").join(targets, "value").where("table_name != ref_table")
    contained = hits.groupBy("table_name", "column_name", "ref_table", "ref_column").agg(F.count("*").alias("n_hit"))
    foreign = contained.join(per_column, ["table_name", "column_name"]).where("n_hit = n_distinct")
    return primary.unionByName(
        foreign.select("table_name", "column_name", F.lit("FOREIGN KEY").alias("constraint_type"), "ref_table", "ref_column")
    )
