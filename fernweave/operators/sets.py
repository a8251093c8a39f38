"""Unions of differing tables and rules for which duplicate to keep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.coerce import target_type
from fernweave.operators.ranking import first_per_key
from fernweave.operators.semantics import map_values


@dataclass(frozen=True)
class UnionSource:
    """One table of an aligned union: its frame, identity and the column each output comes from."""

    table: str
    table_id: int
    df: DataFrame
    columns: dict[str, str]


def aligned_union(
    sources: list[UnionSource], output: dict[str, str], value_maps: dict[tuple[str, str], dict[str, str]] | None = None
) -> DataFrame:
    """UNION ALL of tables under shared output columns.

    ``output`` gives each column's type name; values are mapped per (table, output
    column), cast, and NULL where a table lacks the column.
    """
    def part(s: UnionSource) -> DataFrame:
        columns = []
        for name, type_name in output.items():
            value: Column = F.lit(None)
            if name in s.columns:
                value = map_values(F.col(s.columns[name]), (value_maps or {}).get((s.table, name), {}))
            columns.append(value.try_cast(target_type(type_name)).alias(name))
        return s.df.select(
            *columns, F.lit(s.table).alias("_source_table"), F.lit(s.table_id).alias("_source_table_id")
        )

    return reduce(DataFrame.unionByName, [part(s) for s in sources])


def union_all_columns(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*f.columns) for f in frames])


def keep_last(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """One row per key: the one latest in the sequence (a running maximum, combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    last = F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_last.`{c}`") for c in df.columns])


def prefer_filled(df: DataFrame, keys: list[str], field: str, sequence: list[str]) -> DataFrame:
    """One row per key: the first whose field is not empty, else the first."""
    empty = F.coalesce(F.trim(F.col(field)), F.lit("")) == ""
    return first_per_key(df, keys, [empty.asc(), *[F.col(c).asc() for c in sequence]])


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")]


def best_pairs(df: DataFrame, a: str, b: str, score: str, tiebreak: list[str]) -> DataFrame:
    """One row per unordered pair: the one with the highest score."""
    keyed = df.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)})
    order = [F.col(score).desc(), *[F.col(c) for c in tiebreak]]
    return first_per_key(keyed, ["_low", "_high"], order).drop("_low", "_high")


def exclude_pairs(df: DataFrame, existing: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose pair does not exist yet in either direction."""
    known = existing.select(*_pair(a, b)).distinct()
    keyed = df.withColumns({"_low": F.least(a, b), "_high": F.greatest(a, b)})
    return keyed.join(known, ["_low", "_high"], "left_anti").drop("_low", "_high")
