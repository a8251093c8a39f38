"""Column selection, naming, stamping, flattening and identity."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.functions.arrays import explode_map
from fernweave.functions.coerce import lake_safe_frame
from fernweave.functions.paths import asset_path, location_parts, media_type
from fernweave.session import clock

SOURCE_STAMPS = ("_source_table", "_ingestion_timestamp")


def select_columns(df: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """All columns, or the wanted ones in table order."""
    if wanted is None:
        return df
    keep = set(wanted)
    missing = keep - set(df.columns)
    if missing:
        raise ValueError(f"unknown columns: {sorted(missing)}")
    return df.select(*[c for c in df.columns if c in keep])


def prefixed_names(tables: dict[str, list[str]]) -> dict[tuple[str, str], str]:
    """Output name per (table, column): the table's name in front where names clash, ignoring case."""
    seen = Counter(c.lower() for cols in tables.values() for c in cols)
    return {(t, c): (f"{t}_{c}" if seen[c.lower()] > 1 else c) for t, cols in tables.items() for c in cols}


def rename_clashes(
    frames: list[tuple[str, DataFrame]], join_columns: Iterable[str] = (), keep_first: Iterable[str] = SOURCE_STAMPS
) -> tuple[list[DataFrame], dict[tuple[int, str], str]]:
    """Make column names of several frames distinct, ignoring case.

    A name that several frames have becomes ``{table}_{column}`` in each, or
    ``g{index}_{column}`` when that is taken; join columns and names starting with ``_``
    stay.  Columns in ``keep_first`` stay in the first frame only.  Also returns the new
    name per (frame index, column).
    """
    joined, first_only = {c.lower() for c in join_columns}, set(keep_first)
    kept = [[c for c in df.columns if not (i and c in first_only)] for i, (_, df) in enumerate(frames)]
    seen = Counter(c.lower() for columns in kept for c in columns)
    taken, names, out = set(seen), {}, []
    for i, (table, df) in enumerate(frames):
        for c in kept[i]:
            names[i, c] = c
            if seen[c.lower()] > 1 and c.lower() not in joined and not c.startswith("_"):
                by_table = f"{table}_{c}"
                names[i, c] = f"g{i}_{c}" if by_table.lower() in taken else by_table
                taken.add(names[i, c].lower())
        out.append(df.select(*[F.col(f"`{c}`").alias(names[i, c]) for c in kept[i]]))
    return out, names


def stamp_source(df: DataFrame, table: str, at: dt.datetime | None = None) -> DataFrame:
    return df.withColumns({"_source_table": F.lit(table), "_ingestion_timestamp": clock(at)})


def stamp_silver(df: DataFrame, config_id: int, at: dt.datetime | None = None) -> DataFrame:
    return df.withColumns({"_silver_timestamp": clock(at), "_transform_config_id": F.lit(config_id)})


def stamp_rows(
    df: DataFrame,
    dataset_id: int,
    table_id: int,
    table: str,
    connection_type: str,
    types: dict[str, str],
    at: dt.datetime | None = None,
) -> DataFrame:
    """Rows in their declared types, or NULL, with dataset stamps.

    Fractions stay text, as downstream readers of this format expect.
    """
    def cast(name: str, declared: str) -> Column:
        text = declared in ("double", "float") or declared.startswith("decimal")
        return F.col(name).try_cast("string" if text else declared).alias(name)

    return df.select(
        F.lit(dataset_id).alias("_dataset_id"),
        F.lit(table_id).alias("_source_table_id"),
        F.lit(table).alias("_source_table_name"),
        F.lit(connection_type).alias("_source_connection_type"),
        clock(at).alias("_extraction_timestamp"),
        *[cast(n, t) for n, t in types.items()],
    )


def add_asset_paths(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """``_<column>_bronze_path`` beside each asset column."""
    return df.withColumns({f"_{c}_bronze_path": asset_path(F.col(c), prefix) for c in columns})


def unify_asset_paths(df: DataFrame, unified: str, sources: list[str], drop: bool = False) -> DataFrame:
    """The unified column's asset path: the first source path that is there."""
    paths = [f"_{c}_bronze_path" for c in sources if f"_{c}_bronze_path" in df.columns]
    if not paths:
        return df
    name = f"_{unified}_bronze_path"
    df = df.withColumn(name, F.coalesce(*[F.col(p) for p in paths]))
    return df.drop(*[p for p in paths if p != name]) if drop else df


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    first: dict[str, str] = {}
    for position, name in enumerate(df.columns):
        first.setdefault(name, f"_{position}")
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(place).alias(name) for name, place in first.items()])


def drop_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested fields as top-level columns, their path joined with ``sep``."""
    def walk(schema: T.StructType, path: tuple[str, ...]) -> Iterable[Column]:
        for field in schema:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema, ()))


def flatten_json_long(df: DataFrame, key: str, column: str, categories: bool = False) -> DataFrame:
    """A JSON object with unknown keys as (key, field, value) rows.

    With ``categories`` the JSON has two levels and the field is ``{category}_{field}``.
    """
    if not categories:
        return explode_map(df, [key], F.from_json(column, "map<string,string>"), "field", "value")
    outer = explode_map(df, [key], F.from_json(column, "map<string,map<string,string>>"), "category", "fields")
    inner = explode_map(outer, [key, "category"], F.col("fields"), "name", "value")
    return inner.select(key, F.concat_ws("_", "category", "name").alias("field"), "value")


def pick_json(c: Column, picks: dict[str, tuple[str, str, object]]) -> list[Column]:
    """Named values out of a JSON column: ``{output: (path, type, default)}``."""
    return [
        F.coalesce(F.get_json_object(c, path).try_cast(dtype), F.lit(default).cast(dtype)).alias(name)
        for name, (path, dtype, default) in picks.items()
    ]


def rename_mapped(df: DataFrame, table: str, mapping: dict[str, str]) -> DataFrame:
    """Rename by ``table.column`` first, then by ``column``; ``_base64`` twins follow their column."""
    def renamed(name: str) -> str:
        stem = name.removesuffix("_base64")
        new = mapping.get(f"{table}.{stem}", mapping.get(stem, stem))
        return new if stem == name else f"{new}_base64"

    return df.withColumnsRenamed({c: renamed(c) for c in df.columns})


def align(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns, in this order; absent ones as NULL of the given type."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in columns.items()])


def map_headers(df: DataFrame, synonyms: dict[str, list[str]], exact: Iterable[str] = ()) -> DataFrame:
    """Select columns by header words: the first synonym a header contains names the field.

    Fields in ``exact`` need the whole header to be the word.
    """
    chosen: dict[str, str] = {}
    for header in df.columns:
        low = header.strip().lower()
        for field, words in synonyms.items():
            hit = low in words if field in exact else any(w in low for w in words)
            if hit:
                chosen[field] = header
                break
    return df.select(*[F.coalesce(F.trim(F.col(f"`{h}`").cast("string")), F.lit("")).alias(f) for f, h in chosen.items()])


def row_identity(df: DataFrame, keys: list[str], sep: str = "|", with_json: bool = False) -> DataFrame:
    """``record_id``: SHA-256 over the key values; optionally the row as JSON."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    out = {"record_id": F.sha2(F.concat_ws(sep, *parts), 256)}
    if with_json:
        out["raw_json"] = F.to_json(F.struct(*df.columns))
    return df.withColumns(out)


def query_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """``query_hash``: the first eight hex digits of an MD5 over the columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("query_hash", F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8))


def attach_files(df: DataFrame, path_column: str, files: DataFrame) -> DataFrame:
    """Add each referenced file's content as base64 with its type; NULL when the file is absent.

    ``files`` is a ``binaryFile`` scan.
    """
    content = files.select(
        F.col("path").alias("_file_path"), F.base64("content").alias(f"{path_column}_base64"),
        media_type(F.col("path")).alias(f"{path_column}_type"),
    )
    return df.join(content, F.col(path_column) == F.col("_file_path"), "left").drop("_file_path")


def asset_copy_plan(df: DataFrame, column: str, destination: str, bucket: str = "") -> DataFrame:
    """One row per distinct asset: where it lies and where its copy goes.

    A path without a scheme lies in ``bucket``; assets without a bucket or key are left out.
    """
    paths = df.select(F.col(column).alias("source")).where("source != ''").distinct()
    parts = location_parts(F.col("source"))
    whole = parts["scheme"].isNotNull()
    here = F.when(whole, parts["bucket"]).otherwise(F.lit(bucket))
    key = F.when(whole, parts["key"]).otherwise(F.regexp_replace("source", "^/+|/+$", ""))
    plan = paths.select("source", here.alias("bucket"), key.alias("key")).where("bucket != '' AND key != ''")
    return plan.withColumn("destination", asset_path(F.col("key"), destination))


def lake_safe(df: DataFrame) -> DataFrame:
    """Every column in a type a lake table holds."""
    return lake_safe_frame(df)
