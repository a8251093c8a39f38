"""Unified datasets: one set of columns over several tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions.coerce import unify_types
from fernweave.operators.aggregates import percent
from fernweave.operators.sets import UnionSource, aligned_union
from fernweave.sinks.tables import append_batch


@dataclass(frozen=True)
class SourceColumn:
    id: int
    table: str
    name: str
    type: str


@dataclass(frozen=True)
class MappedGroup:
    """A column group: unified name, its dictionary type if any, member column ids."""

    name: str
    column_ids: tuple[int, ...]
    type: str | None = None


@dataclass(frozen=True)
class UnifiedColumn:
    name: str
    type: str
    sources: tuple[SourceColumn, ...]
    mapped: bool


def unified_columns(
    columns: list[SourceColumn], groups: list[MappedGroup], chosen: set[int] | None = None
) -> list[UnifiedColumn]:
    """Mapped columns first, then every other column under a free name.

    A taken name becomes ``column_table``, then ``column_table_n``.
    """
    wanted = [c for c in columns if chosen is None or c.id in chosen]
    out, used = [], set()
    for group in groups:
        members = tuple(c for i in group.column_ids for c in wanted if c.id == i)
        if members:
            out.append(UnifiedColumn(group.name, group.type or unify_types([m.type for m in members]), members, True))
            used.update(m.id for m in members)
    names = {u.name for u in out}
    for c in wanted:
        if c.id in used:
            continue
        name, n = c.name, 0
        while name in names:
            name = f"{c.name}_{c.table}" if n == 0 else f"{c.name}_{c.table}_{n}"
            n += 1
        names.add(name)
        out.append(UnifiedColumn(name, c.type, (c,), False))
    return out


def unified_rows(
    frames: dict[str, DataFrame],
    table_ids: dict[str, int],
    plan: list[UnifiedColumn],
    value_maps: dict[int, dict[str, str]] | None = None,
    limits: dict[str, int] | None = None,
    order: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The rows of all tables under the unified columns.

    ``limits`` keeps a table's first rows in the given order.
    """
    sources, maps = [], {}
    for table, df in frames.items():
        if limits and table in limits:
            df = df.orderBy(*(order or {}).get(table, df.columns)).limit(limits[table])
        found = {u.name: c for u in plan for c in u.sources if c.table == table}
        sources.append(UnionSource(table, table_ids[table], df, {n: c.name for n, c in found.items()}))
        maps.update({(table, n): value_maps[c.id] for n, c in found.items() if value_maps and c.id in value_maps})
    return aligned_union(sources, {u.name: u.type for u in plan}, maps)


def write_unified(rows: DataFrame, path: str, dataset_id: int, batch_id: int, at: dt.datetime | None = None) -> None:
    """Store unified rows as one stamped batch."""
    append_batch(rows, path, dataset_id, batch_id, at=at)


def unify_preview(selected: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per selected table: columns, mapped columns, share, and columns left under their own name."""
    chosen = columns.join(selected.select("table_id").distinct(), "table_id", "left_semi")
    mapped = mappings.select(F.col("column_id").alias("_m")).distinct()
    joined = chosen.join(mapped, F.col("column_id") == F.col("_m"), "left")
    out = joined.groupBy("table_id").agg(F.count("*").alias("total_columns"), F.count("_m").alias("mapped_columns"))
    return out.withColumns(
        {
            "individual_columns": F.col("total_columns") - F.col("mapped_columns"),
            "mapped_percentage": percent(F.col("mapped_columns"), F.col("total_columns")),
        }
    )


def estimated_columns(selected: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """How many columns the unified dataset gets: one per group reached, one per unmapped column."""
    chosen = columns.join(selected.select("table_id").distinct(), "table_id", "left_semi").select("column_id")
    reached = mappings.join(chosen, "column_id", "left_semi")
    unmapped = chosen.join(mappings.select("column_id").distinct(), "column_id", "left_anti")
    groups = reached.agg(F.count_distinct("group_id").alias("mapped_groups"))
    return groups.withColumn("individual_columns", unmapped.agg(F.count("*")).scalar()).withColumn(
        "estimated_columns", F.col("mapped_groups") + F.col("individual_columns")
    )


def compatibility(selected: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Selected tables that cannot be unified: unknown to the catalog, or without columns."""
    known = tables.select(F.col("table_id").alias("_t")).distinct()
    filled = columns.select(F.col("table_id").alias("_c")).distinct()
    wanted = selected.select("table_id").distinct()
    marked = wanted.join(known, F.col("table_id") == F.col("_t"), "left").join(filled, F.col("table_id") == F.col("_c"), "left")
    problem = F.when(F.col("_t").isNull(), "missing table").when(F.col("_c").isNull(), "no columns")
    return marked.select("table_id", problem.alias("problem")).where("problem IS NOT NULL")
