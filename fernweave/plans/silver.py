"""The silver transformation: one lazy plan from joined sources to a stamped result.

Order: early filter, value maps and unification on raw values, text changes, late filter,
stamp, extraction, last filter.  A unified column is the first present of its mapped and
changed sources; a source column that is kept gets the text changes only; any other
column gets its value map, then the text changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.config import Relationship, SilverConfig
from fernweave.operators.joins import MappedColumn, join_related, related_columns
from fernweave.operators.predicates import FilterPhases, filter_rows, resolve, split_phases
from fernweave.operators.semantics import map_values, unify
from fernweave.operators.sets import union_all_columns
from fernweave.operators.shape import rename_clashes, stamp_silver, unify_asset_paths
from fernweave.plans.extract import Extractor, extract_column
from fernweave.plans.transform import apply_steps, steps_by_column
from fernweave.sinks.snapshots import write_snapshot
from fernweave.sources.snapshots import Commit, read_snapshot, resolve_version


class NameClash(ValueError):
    pass


def check_names(source_columns: Iterable[str], config: SilverConfig) -> None:
    """Derived names must differ from each other and from source columns, ignoring case.

    A group may carry the name of one of its own sources.
    """
    sources = {c.lower() for c in source_columns}
    seen: set[str] = set()
    for group in config.groups:
        name = group.name.lower()
        if name in seen:
            raise NameClash(f"two groups are named {group.name!r}")
        if name in sources and name not in {c.lower() for c in group.columns}:
            raise NameClash(f"group {group.name!r} has the name of a column it does not contain")
        seen.add(name)
    for extraction in config.extractions:
        name = extraction.output.lower()
        if name in seen or name in sources:
            raise NameClash(f"extracted column {extraction.output!r} is already there")
        seen.add(name)


def combine_sources(
    tables: dict[str, DataFrame], relationships: list[Relationship] | None, default_how: str = "full", config: SilverConfig | None = None
) -> DataFrame:
    """Join the sources along their links, or stack them when there are none.

    With ``config``, conditions of its early filter on unified keys are applied to every
    source that holds the key: rows that are joined have equal keys, so no join type changes
    its result.  Conditions on other columns are moved to their sources by Catalyst, as far
    as the join types allow.  The whole filter is still to be applied to the result.
    """
    if len(tables) == 1:
        return next(iter(tables.values()))
    if not relationships:
        return union_all_columns(list(tables.values()))
    if config:
        tables = _prefiltered(tables, related_columns(tables, relationships), config)
    return join_related(tables, relationships, default_how)[0]


def _prefiltered(tables: dict[str, DataFrame], mapping: list[MappedColumn], config: SilverConfig) -> dict[str, DataFrame]:
    """The sources without rows whose key fails a condition that all rows must meet."""
    outputs = list(dict.fromkeys(m.output for m in mapping))
    early = phases(outputs, config).before or {}
    if early.get("logic", "AND").upper() != "AND":
        return tables
    tables = dict(tables)
    for cond in early.get("conditions", []):
        members = [m for m in mapping if m.is_unified and m.output == resolve(cond, outputs, config.column_ids)]
        if len({tables[m.table].schema[m.column].dataType for m in members}) == 1:
            for m in members:
                own = {k: v for k, v in cond.items() if k not in ("column_id", "column")}
                tables[m.table] = filter_rows(tables[m.table], {"conditions": [own | {"column_name": m.column}]})
    return tables


def combine_groups(
    groups: dict[str, DataFrame], links: list[Relationship], default_how: str = "full", labels: dict[str, str] | None = None,
    config: SilverConfig | None = None,
) -> DataFrame:
    """Combine stored groups: clashing names get the group's label in front, provenance comes from the first."""
    keys = {c for r in links for c in (r.left_column, r.right_column)}
    frames, _ = rename_clashes([((labels or {}).get(n, n), df) for n, df in groups.items()], keys)
    return combine_sources(dict(zip(groups, frames, strict=True)), links, default_how, config)


def unify_and_transform(df: DataFrame, config: SilverConfig) -> DataFrame:
    """Unified columns, value maps and text changes in one projection."""
    steps = steps_by_column(config.transformations, df.columns, config.column_ids)
    grouped = {c for g in config.groups for c in g.columns if c in df.columns}
    unified_names = {g.name for g in config.groups}
    out = []
    for name in df.columns:
        if name in unified_names or (name in grouped and config.drop_unified_sources):
            continue
        raw = F.col(f"`{name}`")
        value = raw if name in grouped else map_values(raw, config.value_maps.get(name, {}))
        out.append(apply_steps(value, steps.get(name, [])).alias(name))
    for group in config.groups:
        present = [c for c in dict.fromkeys(group.columns) if c in df.columns]
        if not present:
            continue
        values = []
        for name in present:
            mapped = map_values(F.col(f"`{name}`"), group.value_maps.get(name, config.value_maps.get(name, {})))
            values.append(apply_steps(mapped, steps.get(name, [])))
        out.append(unify(values).alias(group.name))
    result = df.select(*out)
    for group in config.groups:
        result = unify_asset_paths(result, group.name, list(group.columns), config.drop_unified_sources)
    return result


def phases(columns: list[str], config: SilverConfig) -> FilterPhases:
    """The configured filter, split by when each condition can be decided."""
    ids = {name: cid for cid, name in config.column_ids.items()}
    transformed = {s.column for s in config.transformations}
    changed = transformed | {ids.get(c) for c in transformed} | {config.column_ids.get(c) for c in transformed}
    sources = {c for g in config.groups for c in g.columns} if config.drop_unified_sources else set()
    return split_phases(
        config.filters,
        [e.output for e in config.extractions],
        [g.name for g in config.groups],
        changed - {None},
        sources | {ids[c] for c in sources if c in ids},
        columns,
    )


def _late_ids(config: SilverConfig) -> dict[int, str]:
    """Column ids after unification: a dropped source is found under its group's name."""
    if not config.drop_unified_sources:
        return config.column_ids
    groups = {c: g.name for g in config.groups for c in g.columns}
    return {cid: groups.get(name, name) for cid, name in config.column_ids.items()}


def transform(
    df: DataFrame, config: SilverConfig, extractors: dict[str, Extractor] | None = None, at: dt.datetime | None = None
) -> DataFrame:
    """Run the whole transformation on combined sources."""
    check_names(df.columns, config)
    split = phases(df.columns, config)
    out = filter_rows(df, split.before, column_ids=config.column_ids)
    out = unify_and_transform(out, config)
    late = _late_ids(config)
    out = filter_rows(out, split.after_transform, column_ids=late)
    out = stamp_silver(out, config.id, at)
    for extraction in config.extractions:
        out = extract_column(out, extraction, (extractors or {})[extraction.output])
    return filter_rows(out, split.after_extract, column_ids=late)


def run_silver(
    spark: SparkSession,
    sources: dict[str, tuple[str, int | None]],
    links: list[Relationship],
    config: SilverConfig,
    target: str,
    extractors: dict[str, Extractor] | None = None,
    labels: dict[str, str] | None = None,
    at: dt.datetime | None = None,
) -> Commit:
    """Read stored groups (path, version or None for the latest), transform, write a new version.

    The commit records the versions that were read.
    """
    versions = {n: resolve_version(spark, path, version) for n, (path, version) in sources.items()}
    groups = {n: read_snapshot(spark, path, versions[n]) for n, (path, _) in sources.items()}
    df = transform(combine_groups(groups, links, labels=labels, config=config), config, extractors, at)
    return write_snapshot(df, target, config={"id": config.id, "sources": versions}, at=at)


def virtual_view(
    tables: dict[str, DataFrame], relationships: list[Relationship], config: SilverConfig, default_how: str = "full"
) -> DataFrame:
    """The same configuration as a view: joined, mapped and filtered on demand, without stamps."""
    df = combine_sources(tables, relationships, default_how, config)
    check_names(df.columns, config)
    split = phases(df.columns, config)
    out = unify_and_transform(filter_rows(df, split.before, column_ids=config.column_ids), config)
    return filter_rows(out, split.after_transform, column_ids=_late_ids(config))

