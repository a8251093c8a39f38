"""Bronze ingest: which tables go together, and one stored result per group."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from fernweave.config import Relationship
from fernweave.functions.paths import safe_name
from fernweave.operators.joins import MappedColumn, connected_components, join_order, join_related, related_columns
from fernweave.operators.shape import add_asset_paths, lake_safe, select_columns, stamp_source
from fernweave.sinks.snapshots import write_snapshot
from fernweave.sinks.tables import run_groups

MAPPING_SCHEMA = "group_name string, table_name string, column_name string, output_name string, is_prefixed boolean, is_unified boolean"


@dataclass(frozen=True)
class BronzeGroup:
    """Tables stored together and the relationships that join them."""

    name: str
    tables: tuple[str, ...]
    relationships: tuple[Relationship, ...]


@dataclass(frozen=True)
class BronzePlan:
    groups: tuple[BronzeGroup, ...]
    links: tuple[Relationship, ...]  # between groups, for the silver layer


def plan_bronze(
    connections: dict[str, str], relationships: list[Relationship], name: str = "bronze", federated: bool = False
) -> BronzePlan:
    """Group selected tables (table: connection) by connection and by relationship.

    With ``federated`` one group spans all connections; relationships across groups
    become links.
    """
    usable = [r for r in relationships if r.active and {r.left_table, r.right_table} <= set(connections)]
    if federated:
        return BronzePlan((BronzeGroup(f"{safe_name(name)}_federated", tuple(connections), tuple(usable)),), ())
    groups = []
    for connection in dict.fromkeys(connections.values()):
        tables = [t for t, c in connections.items() if c == connection]
        parts = connected_components(tables, usable)
        for number, part in enumerate(parts):
            label = f"part_{safe_name(connection)}" + (f"_{number}" if len(parts) > 1 else "")
            inside = tuple(r for r in usable if {r.left_table, r.right_table} <= set(part))
            groups.append(BronzeGroup(label, tuple(part), inside))
    placed = {t: g.name for g in groups for t in g.tables}
    links = tuple(r for r in usable if placed[r.left_table] != placed[r.right_table])
    return BronzePlan(tuple(groups), links)


def build_group(
    frames: dict[str, DataFrame],
    group: BronzeGroup,
    columns: dict[str, list[str]] | None = None,
    assets: list[str] = (),
    prefix: str = "",
    at: dt.datetime | None = None,
) -> tuple[DataFrame, list[MappedColumn]]:
    """The group's rows: chosen columns, lake-safe types, joined, asset paths, source stamps."""
    chosen = {t: lake_safe(select_columns(frames[t], (columns or {}).get(t))) for t in group.tables}
    joined, mapping = join_related(chosen, list(group.relationships), "inner")
    start, _ = join_order(list(group.tables), list(group.relationships))
    present = [a for a in assets if a in joined.columns]
    return stamp_source(add_asset_paths(joined, present, prefix) if present else joined, start, at), mapping


def group_mappings(
    frames: dict[str, DataFrame], plan: BronzePlan, columns: dict[str, list[str]] | None = None
) -> dict[str, list[MappedColumn]]:
    """Where every source column ends up, per group; nothing is read for it."""
    def chosen(group: BronzeGroup) -> dict[str, DataFrame]:
        return {t: lake_safe(select_columns(frames[t], (columns or {}).get(t))) for t in group.tables}

    return {g.name: related_columns(chosen(g), list(g.relationships)) for g in plan.groups}


def group_links(plan: BronzePlan, mappings: dict[str, list[MappedColumn]]) -> list[Relationship]:
    """The plan's links in terms of the stored groups and their column names."""
    place = {(m.table, m.column): (group, m.output) for group, ms in mappings.items() for m in ms}
    links = []
    for r in plan.links:
        (left, left_column), (right, right_column) = place[r.left_table, r.left_column], place[r.right_table, r.right_column]
        links.append(replace(r, left_table=left, left_column=left_column, right_table=right, right_column=right_column))
    return links


def mapping_table(spark: SparkSession, mappings: dict[str, list[MappedColumn]]) -> DataFrame:
    """Where every source column ended up, per group."""
    rows = [(g, m.table, m.column, m.output, m.is_prefixed, m.is_unified) for g, ms in mappings.items() for m in ms]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def run_bronze(
    frames: dict[str, DataFrame],
    plan: BronzePlan,
    folder: str,
    columns: dict[str, list[str]] | None = None,
    assets: list[str] = (),
    partition_by: list[str] | None = None,
    at: dt.datetime | None = None,
) -> dict[str, dict]:
    """Write every group under its own name; returns status and path per group."""
    def job(group: BronzeGroup) -> Callable[[], str]:
        def write() -> str:
            path = f"{folder.rstrip('/')}/{group.name}"
            df, _ = build_group(frames, group, columns, assets, f"{path}/_assets", at)
            write_snapshot(df, path, partition_by=partition_by, at=at)
            return path

        return write

    return run_groups({g.name: job(g) for g in plan.groups})
