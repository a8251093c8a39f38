"""Declarations that drive the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Relationship:
    """A declared link between two tables.

    ``condition`` is an extra SQL condition over ``table.column`` names, added to the
    key equality (an equality is always needed, so no join compares all pairs).
    ``cardinality`` (``one_to_one``, ``one_to_many``, ``many_to_one``, ``many_to_many``)
    says on which side a key occurs once; outer joins are cheaper when it is known.
    """

    left_table: str
    left_column: str
    right_table: str
    right_column: str
    how: str = "inner"
    condition: str | None = None
    active: bool = True
    cardinality: str = "many_to_many"


@dataclass(frozen=True)
class ColumnGroup:
    """Columns that mean the same thing; ``name`` is the unified output column."""

    name: str
    columns: tuple[str, ...]
    value_maps: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Transformation:
    """A text change on one column: a named step, or ``template`` / ``rule`` with an argument."""

    column: str | int
    kind: str
    argument: str | None = None


@dataclass(frozen=True)
class Extraction:
    """A yes/no or one-of-several column derived from text by a callable."""

    source: str
    output: str
    values: tuple[str, ...] | None = None  # None: boolean


@dataclass(frozen=True)
class SilverConfig:
    """Everything the silver transformation needs."""

    id: int
    pre_keys: tuple[str, ...] = ()
    filters: dict | None = None
    groups: tuple[ColumnGroup, ...] = ()
    value_maps: dict[str, dict[str, str]] = field(default_factory=dict)
    transformations: tuple[Transformation, ...] = ()
    extractions: tuple[Extraction, ...] = ()
    drop_unified_sources: bool = False
    column_ids: dict[int, str] = field(default_factory=dict)
