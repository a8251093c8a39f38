"""Joins along declared relationships, lookups and membership tests.

Join strategy is left to Catalyst and adaptive execution: a side is broadcast only when
its measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and hot keys are
split by the skew-join rule.  That rule cannot split both sides of an outer join, so the
heaviest keys of large sides are counted first: rows of all other keys take the plain outer
join, which reads each side once and lets filters through to the scans; the few heavy keys
take an inner join and anti joins, whose sides can be split.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.config import Relationship
from fernweave.operators.shape import prefixed_names


class UnlinkedTablesError(ValueError):
    """Tables that no relationship connects; the engine never multiplies them out."""

    def __init__(self, tables: list[str]) -> None:
        super().__init__(f"no relationship reaches: {', '.join(tables)}")
        self.tables = tables


def _with_nulls(df: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema]
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *absent).select(*[F.col(f"`{c}`") for c in columns])


#: Rows from which a key counts as heavy, keys looked for, and bytes from which a side may hold any.
HOT_ROWS = 1_000_000
HOT_KEYS, TRACKED = 1000, 100_000
HOT_BYTES = 256 << 20

#: Key types whose equal values have equal hashes.
_HASHED = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)


def _hashed(columns: list[str]) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns))


def hot_keys(df: DataFrame, columns: list[str]) -> set[int]:
    """Hashes of the keys that hold ``HOT_ROWS`` rows or more: at most ``HOT_KEYS``.

    One pass over the key columns with a sketch of bounded size; a frame that Spark estimates
    below ``HOT_BYTES`` is not read, as one task can hold it all.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < HOT_BYTES:
        return set()
    keys = df.select(_hashed(columns).alias("h"), reduce(operator.and_, [F.col(f"`{c}`").isNotNull() for c in columns]).alias("known"))
    top = keys.where("known").agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED})")).first()[0]
    return {entry["item"] for entry in top or [] if entry["count"] >= HOT_ROWS}


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    pairs: list[tuple[str, str]],
    how: str = "inner",
    extra: str | None = None,
    right_unique: bool = False,
    left_unique: bool = False,
    hot: set[int] | None = None,
) -> DataFrame:
    """Equi-join of two frames with disjoint column names.

    ``left_unique`` / ``right_unique`` say that a key occurs once on that side.  Then one
    outer join keeps the other side's rows and can still split that side's hot keys.
    Otherwise an outer join treats the keys with the hashes ``hot`` apart, by default those
    that ``hot_keys`` finds on either side; any set of hashes gives the same rows.
    """
    if not pairs:
        raise ValueError("a join needs at least one key pair")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join type {how!r}")
    condition = reduce(operator.and_, [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in pairs])
    if extra:
        condition = condition & F.expr(extra)
    if how == "inner" or how == "left" and right_unique or how == "right" and left_unique:
        return left.join(right, condition, how)
    here, there = ([p[i] for p in pairs] for i in (0, 1))
    kinds = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in pairs]
    if any(a != b or not isinstance(a, _HASHED) for a, b in kinds):
        hot = set()
    elif hot is None:
        hot = hot_keys(left, here) | hot_keys(right, there)
    if not hot:
        return left.join(right, condition, how)

    is_hot = [_hashed(columns).isin(sorted(hot)) for columns in (here, there)]
    out = left.where(~is_hot[0]).join(right.where(~is_hot[1]), condition, how)
    left, right, columns = left.where(is_hot[0]), right.where(is_hot[1]), [*left.columns, *right.columns]
    out = out.unionByName(left.join(right, condition))
    if how in ("left", "full"):
        others = right if extra else right.select(*map(_quoted, there)).distinct()
        out = out.unionByName(_with_nulls(left.join(others, condition, "left_anti"), right, columns))
    if how in ("right", "full"):
        others = left if extra else left.select(*map(_quoted, here)).distinct()
        out = out.unionByName(_with_nulls(right.join(others, condition, "left_anti"), left, columns))
    return out


def _quoted(column: str) -> str:
    return f"`{column}`"


@dataclass(frozen=True)
class MappedColumn:
    """Where a source column ended up."""

    table: str
    column: str
    output: str
    is_prefixed: bool
    is_unified: bool


def connected_components(tables: list[str], relationships: list[Relationship]) -> list[list[str]]:
    """Tables grouped by the relationships between them, in the given order."""
    neighbours: dict[str, set[str]] = {t: set() for t in tables}
    for r in relationships:
        if r.active and r.left_table in neighbours and r.right_table in neighbours:
            neighbours[r.left_table].add(r.right_table)
            neighbours[r.right_table].add(r.left_table)
    seen: set[str] = set()
    groups = []
    for start in tables:
        if start in seen:
            continue
        group, queue = {start}, [start]
        while queue:
            fresh = neighbours[queue.pop()] - group
            group |= fresh
            queue.extend(fresh)
        seen |= group
        groups.append([t for t in tables if t in group])
    return groups


def join_order(tables: list[str], relationships: list[Relationship]) -> tuple[str, list[tuple[str, Relationship]]]:
    """The table to start from and the (table to add, relationship) steps.

    The start is the table most often on the left; relationships are walked until no
    further table can be added, and one whose two tables are both in is left out.
    """
    usable = [r for r in relationships if r.active and {r.left_table, r.right_table} <= set(tables)]
    start = max(tables, key=lambda t: sum(r.left_table == t for r in usable))
    joined, steps, progress = {start}, [], True
    while progress:
        progress = False
        for r in usable:
            inside = {r.left_table, r.right_table} & joined
            if len(inside) == 1:
                new = r.right_table if r.left_table in joined else r.left_table
                steps.append((new, r))
                joined.add(new)
                progress = True
    unreached = [t for t in tables if t not in joined]
    if unreached:
        raise UnlinkedTablesError(unreached)
    return start, steps


def _q(table: str, column: str) -> str:
    return f"{table}__{column}"


def with_actual_names(tables: dict[str, DataFrame], relationships: list[Relationship], strict: bool = True) -> list[Relationship]:
    """Relationships with their key columns spelled as the tables spell them.

    A key column that is not there is an error, or leaves the relationship out.
    """
    out = []
    for r in relationships:
        if not r.active or not {r.left_table, r.right_table} <= set(tables):
            continue
        left = {c.lower(): c for c in tables[r.left_table].columns}.get(r.left_column.lower())
        right = {c.lower(): c for c in tables[r.right_table].columns}.get(r.right_column.lower())
        if left and right:
            out.append(replace(r, left_column=left, right_column=right))
        elif strict:
            raise ValueError(f"no such key: {r.left_table}.{r.left_column} = {r.right_table}.{r.right_column}")
    return out


class _Unified:
    """Key columns that relationships make one, in the order of their joins."""

    def __init__(self) -> None:
        self.groups: list[list[tuple[str, str]]] = []  # first the column that names the group

    def add(self, a: tuple[str, str], b: tuple[str, str]) -> list[tuple[str, str]]:
        group = next((g for g in self.groups if a in g or b in g), None)
        if group is None:
            self.groups.append(group := [a, b])
        group.extend(k for k in (a, b) if k not in group)
        return group


def related_columns(tables: dict[str, DataFrame], relationships: list[Relationship], strict: bool = True) -> list[MappedColumn]:
    """Where ``join_related`` puts every source column; nothing is joined or read."""
    _, steps = join_order(list(tables), with_actual_names(tables, relationships, strict))
    unified = _Unified()
    for _, r in steps:
        unified.add((r.left_table, r.left_column), (r.right_table, r.right_column))
    return _mapping(tables, unified.groups)


def join_related(
    tables: dict[str, DataFrame], relationships: list[Relationship], default_how: str = "inner", strict: bool = True
) -> tuple[DataFrame, list[MappedColumn]]:
    """Join tables along their relationships; key columns are found ignoring case.

    Join keys of a relationship become one column under the left column's name, the
    first side that has a value, and later joins on such a key use that column; other
    clashing names get their table in front.  An unknown join type means
    ``default_how``, always with the result so far on the left.

    The result is one lazy plan.  Before an outer join of keys that may repeat on both sides,
    heavy keys are looked for in the tables that hold them, if these are large.
    """
    start, steps = join_order(list(tables), with_actual_names(tables, relationships, strict))
    qualified = {t: df.select(*[F.col(f"`{c}`").alias(_q(t, c)) for c in df.columns]) for t, df in tables.items()}
    out = qualified[start]
    unified = _Unified()
    key_of = {(t, c): _q(t, c) for t, df in tables.items() for c in df.columns}
    rows_repeat = False  # once a join may repeat rows, no key of the result so far is known to be unique
    heavy: dict[tuple[str, str], set[int]] = {}
    for number, (new, r) in enumerate(steps):
        a, b = (r.left_table, r.left_column), (r.right_table, r.right_column)
        here, there = (a, b) if new == r.right_table else (b, a)
        extra = _qualified_condition(r.condition, tables) if r.condition else None
        how = r.how if r.how in ("inner", "left", "right", "full") else default_how
        one_left, one_right = r.cardinality.startswith("one_to"), r.cardinality.endswith("to_one")
        new_unique = one_right if new == r.right_table else one_left
        old_unique = not rows_repeat and (one_left if new == r.right_table else one_right)
        rows_repeat = rows_repeat or not new_unique
        key = key_of[here]
        group = unified.add(a, b)
        hot: set[int] | None = set()
        if not (how == "inner" or how == "left" and new_unique or how == "right" and old_unique):
            for table, column in (member for member in group if member in (here, there) or key_of[member] == key):
                if (table, column) not in heavy:
                    heavy[table, column] = hot_keys(tables[table], [column])
                hot |= heavy[table, column]
        out = keyed_join(out, qualified[new], [(key, key_of[there])], how, extra, new_unique, old_unique, hot)
        if how in ("right", "full"):  # the key may now be on the new side only
            out = out.withColumn(f"__key{number}", F.coalesce(F.col(f"`{key}`"), F.col(f"`{key_of[there]}`")))
            key = f"__key{number}"
        key_of.update(dict.fromkeys(group, key))
    mapping = _mapping(tables, unified.groups)
    columns = [F.col(f"`{key_of[group[0]]}`").alias(next(m.output for m in mapping if (m.table, m.column) == group[0])) for group in unified.groups]
    columns += [F.col(f"`{_q(m.table, m.column)}`").alias(m.output) for m in mapping if not m.is_unified]
    return out.select(*columns), mapping


def _qualified_condition(condition: str, tables: dict[str, DataFrame]) -> str:
    """``table.column`` names as the columns are called while joining."""
    return re.sub(r"\b(\w+)\.(\w+)\b", lambda m: _q(*m.groups()) if m.group(1) in tables else m.group(0), condition)


def _mapping(tables: dict[str, DataFrame], groups: list[list[tuple[str, str]]]) -> list[MappedColumn]:
    """Output names: unified keys first, then the other columns of each table."""
    unified = {member for group in groups for member in group}
    key_names = [group[0][1] for group in groups]
    plain = {t: [c for c in df.columns if (t, c) not in unified] for t, df in tables.items()}
    names = prefixed_names({**plain, "": key_names})
    mapping: list[MappedColumn] = []
    for group in groups:
        table, column = group[0]
        output = column if key_names.count(column) == 1 else f"{table}_{column}"
        mapping += [MappedColumn(t, c, output, False, True) for t, c in group]
    return mapping + [MappedColumn(t, c, names[t, c], names[t, c] != c, False) for t, cols in plain.items() for c in cols]


def unlinked_tables(tables: list[str], relationships: list[Relationship]) -> list[str]:
    """Tables outside the largest connected group: the ones a join would have to multiply out."""
    groups = connected_components(tables, relationships)
    largest = max(groups, key=len)
    return [t for t in tables if t not in largest]


def lookup_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, suffix: str = "_right") -> DataFrame:
    """Left join of a lookup; clashing names of the lookup get a suffix.

    A lookup normally lists a key once; one that does not still gives every match.
    """
    right_on = right_on or on
    renamed = {c: f"{c}{suffix}" for c in right.columns if c in left.columns}
    lookup = right.withColumnsRenamed(renamed)
    key = renamed.get(right_on, right_on)
    joined = keyed_join(left, lookup, [(on, key)], "left", right_unique=True)
    return joined.drop(key) if on == right_on else joined


def chained_query(
    base: tuple[str, DataFrame],
    joins: list[tuple[str, DataFrame, str, str]],
    where: str | None = None,
    select: list[str] | None = None,
    order_by: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``{select, from, joins, where, limit}``: chained left lookups, then filter, columns and rows.

    Each join is (table, frame, key so far, key in the frame); ``select`` takes
    ``column`` or ``table.column``.
    """
    out, origin = base[1], {(base[0], c): c for c in base[1].columns}
    for table, df, on, right_on in joins:
        for c in df.columns:
            origin[table, c] = c if c not in out.columns else (on if c == on == right_on else f"{c}_{table}")
        out = lookup_join(out, df, on, right_on, suffix=f"_{table}")
    if where:
        out = out.where(where)
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    if select:
        out = out.select(*[origin[tuple(s.split(".", 1))] if "." in s else s for s in select])
    return out


def name_lookup(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, output: str) -> DataFrame:
    """Look a name up by key, compared as text; empty text when the key is blank or unknown.

    A key listed twice in ``names`` counts once, with its smallest name.
    """
    lookup = names.groupBy(F.col(name_key).cast("string").alias("_name_key")).agg(F.min(name).alias(output))
    keyed = df.withColumn("_key", F.col(key).cast("string"))
    joined = keyed_join(keyed, lookup, [("_key", "_name_key")], "left", right_unique=True)
    return joined.withColumn(output, F.coalesce(output, F.lit(""))).drop("_key", "_name_key")


def attach_by_id(df: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Columns derived elsewhere, joined back by row id; one derived row per id."""
    side = derived.withColumnRenamed(key, "_derived_id")
    return keyed_join(df, side, [(key, "_derived_id")], "left", right_unique=True).drop("_derived_id")


def membership_flag(df: DataFrame, key: str, members: DataFrame, member_key: str, output: str) -> DataFrame:
    """Whether each row's key is among the members."""
    side = members.select(F.col(member_key).alias("_member")).distinct()
    joined = keyed_join(df, side, [(key, "_member")], "left", right_unique=True)
    return joined.withColumn(output, F.col("_member").isNotNull()).drop("_member")


def absent_rows(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is in no row of ``others``."""
    return df.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def present_in(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is in some row of ``others``."""
    return df.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_semi")


def compare_versions(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows in both versions with ``_old`` / ``_new`` values and the list of changed fields."""
    before = old.select(F.col(key).alias("_old_key"), *[F.col(f).alias(f"{f}_old") for f in fields])
    after = new.select(key, *[F.col(f).alias(f"{f}_new") for f in fields])
    joined = after.join(before, F.col(key) == F.col("_old_key")).drop("_old_key")
    changed = F.array(*[F.when(~F.col(f"{f}_new").eqNullSafe(F.col(f"{f}_old")), F.lit(f)) for f in fields])
    return joined.withColumn("changed_fields", F.array_compact(changed))


def enrich_latest(
    df: DataFrame, details: DataFrame, keys: list[tuple[str, str]], sequence: list[str], columns: list[str]
) -> DataFrame:
    """Attach detail columns by a composite key; the last detail of a key wins."""
    latest = F.max_by(F.struct(*columns), F.struct(*sequence)).alias("_detail")
    side = details.groupBy(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(keys)]).agg(latest)
    pairs = [(left, f"_k{i}") for i, (left, _) in enumerate(keys)]
    joined = keyed_join(df, side, pairs, "left", right_unique=True)
    return joined.select(*df.columns, *[F.col(f"_detail.{c}").alias(c) for c in columns])


def split_scope(relationships: DataFrame, selected: DataFrame) -> DataFrame:
    """Active relationships with both ends selected, marked intra or inter connection.

    ``relationships``: relationship_id, left_table_id, right_table_id, is_active;
    ``selected``: table_id, connection_id (one row per table).
    """
    def end(side: str) -> DataFrame:
        return selected.select(
            F.col("table_id").alias(f"_{side}"), F.col("connection_id").alias(f"{side}_connection_id")
        )

    both = (
        relationships.where("is_active")
        .join(end("left"), F.col("left_table_id") == F.col("_left"))
        .join(end("right"), F.col("right_table_id") == F.col("_right"))
        .drop("_left", "_right")
    )
    same = F.col("left_connection_id") == F.col("right_connection_id")
    return both.withColumn("scope", F.when(same, "intra").otherwise("inter"))
