"""Equivalent columns, value maps and relationships between tables.

Catalog frames: ``tables`` (table_id, table_name, connection_id), ``columns`` (column_id,
table_id, column_name, data_type, is_primary_key, is_foreign_key, fk_table_id,
fk_column_id), ``relationships`` (relationship_id, left/right table and column ids,
confidence, is_active), ``mappings`` (group_id, column_id).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.coerce import types_joinable_column
from fernweave.operators.ranking import first_per_key
from fernweave.session import stored

INLINE_MAP_LIMIT = 100

# Name patterns of referencing columns, in order, and names of key columns.
REFERENCE_PATTERNS = (r"^(.+)_id$", r"^id_(.+)$", r"^fk_(.+)$", r"^(.+)_fk$", r"^(.+)_key$", r"^ref_(.+)$")
KEY_NAMES = ("id", "pk", "key", "code", "numero", "codigo")

# Scores of discovered relationships.
MIN_OVERLAP = 0.3
NAME_SCORE, NAME_SCORE_OTHER_TYPE, SAME_CONNECTION_BONUS = 0.85, 0.6, 0.1


#: Values of a referencing column in its containment sketch, and the chance that a sketch misleads.
SKETCHED_VALUES = 4096
MISLED = 1e-12

_PAIR = ["left_table", "left_column", "right_table", "right_column"]


def map_values(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Replace values by their standard; others become the default, else stay (as text)."""
    if not mapping:
        return c if default is None else F.lit(default)
    text = c.cast("string")
    other = text if default is None else F.lit(default)
    if len(mapping) > INLINE_MAP_LIMIT:
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return F.coalesce(F.try_element_at(table, text), other)
    out = None
    for source, standard in mapping.items():
        test = text == source
        out = F.when(test, standard) if out is None else out.when(test, standard)
    return out.otherwise(other)


def map_values_table(df: DataFrame, column: str, mapping: DataFrame, output: str) -> DataFrame:
    """The same by a mapping table (source_value, standard_value) of any size.

    Spark broadcasts it only while it is measurably small.
    """
    lookup = mapping.groupBy(F.col("source_value").alias("_from")).agg(F.max("standard_value").alias("_to"))
    joined = df.join(lookup, F.col(column).cast("string") == F.col("_from"), "left")
    return joined.withColumn(output, F.coalesce("_to", F.col(column).cast("string"))).drop("_from", "_to")


def unify(columns: list[Column]) -> Column:
    """The first value present, in mapping order."""
    return columns[0] if len(columns) == 1 else F.coalesce(*columns)


def nonstandard_values(mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """Mappings whose standard value is not in its group's dictionary list.

    ``mappings``: group_id, standard_value, …; ``terms``: group_id, standard_values (array).
    A group without a list allows every value.
    """
    listed = terms.where(F.size("standard_values") > 0).select("group_id").distinct()
    allowed = terms.select("group_id", F.explode("standard_values").alias("standard_value")).distinct()
    checked = mappings.join(listed, "group_id", "left_semi")
    return checked.join(allowed, ["group_id", "standard_value"], "left_anti")


def column_keys(frames: dict[str, DataFrame], columns: list[tuple[str, str]], totals: bool = False) -> DataFrame:
    """Distinct values of key columns with their frequency: table_name, column_name, value, n.

    Each column is read on its own (the scan prunes to it) and counted in its own type
    before values become text.  ``totals`` adds the table's ``row_count``.
    """
    parts = []
    for table, column in columns:
        value = F.col("value").cast("string")
        rows = frames[table].select(F.col(column).alias("value"))
        # the filter joins on the text would infer, stated here so that all uses share one shuffle
        counted = rows.where(value.isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
        out = [F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), value.alias("value"), F.col("n")]
        if totals:
            out.append(frames[table].agg(F.count("*")).scalar().alias("row_count"))
        parts.append(counted.select(*out))
    return reduce(DataFrame.unionByName, parts)


def discover_overlap(
    frames: dict[str, DataFrame],
    references: list[tuple[str, str]],
    keys: list[tuple[str, str]],
    min_ratio: float = MIN_OVERLAP,
    samples: int = 5,
) -> DataFrame:
    """Column pairs whose values overlap, measured on the data.

    Distinct values meet once per value, so the work is one distinct per column and one
    equi-join; pairs within a table are left out.
    """
    fk, pk = _side(column_keys(frames, references), "right"), _side(column_keys(frames, keys), "left")
    return _scored_overlap(fk.join(pk, "value").where("left_table != right_table"), fk, min_ratio, samples)


def _side(values: DataFrame, side: str) -> DataFrame:
    return values.select(F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"), "value")


def _scored_overlap(hits: DataFrame, fk: DataFrame, min_ratio: float, samples: int) -> DataFrame:
    """Pairs with their share of common values and the first of these, from one row for each common value."""
    totals = fk.groupBy(F.col("right_table").alias("_t"), F.col("right_column").alias("_c")).agg(F.count("*").alias("total"))
    counted = hits.groupBy(*_PAIR).agg(F.count("*").alias("overlap_count"))
    scored = counted.join(totals, (F.col("right_table") == F.col("_t")) & (F.col("right_column") == F.col("_c")))
    ratio = F.col("overlap_count") / F.col("total")
    kept = scored.where(ratio >= min_ratio).select(
        *_PAIR, "overlap_count", ratio.alias("overlap_ratio"), (F.lit(0.5) + ratio * 0.4).alias("confidence")
    )
    if not samples:
        return kept
    first = first_per_key(hits, _PAIR, [F.col("value")], samples)
    listed = first.groupBy(*_PAIR).agg(F.to_json(F.array_sort(F.collect_list("value"))).alias("sample_matches"))
    return kept.join(listed, _PAIR)


def _margin(sampled: int | Column) -> Column | float:
    """How far a share measured on so many values may be off (Hoeffding), but for the chance ``MISLED``."""
    return F.sqrt(F.lit(math.log(1 / MISLED) / 2) / sampled) if isinstance(sampled, Column) else math.sqrt(math.log(1 / MISLED) / 2 / sampled)


def overlap_candidates(fk: DataFrame, pk: DataFrame, min_ratio: float = MIN_OVERLAP, sketch: int = SKETCHED_VALUES) -> DataFrame:
    """Column pairs whose overlap may reach ``min_ratio``: the pair, sampled, matched, exact.

    ``fk`` (right_table, right_column, value) and ``pk`` (left_table, left_column, value) hold
    distinct values.  A column's containment sketch are its values with the least hashes, about
    ``sketch`` of them; one of no more values is whole, so its shares are ``exact``.  Other
    shares may be off by a margin, and a pair is left out only if it falls short even so.
    """
    place = F.shiftrightunsigned(F.xxhash64("value"), 11) / F.lit(float(1 << 53))
    totals = fk.groupBy("right_table", "right_column").agg(F.least(F.lit(1.0), F.lit(float(sketch)) / F.count("*")).alias("share"))
    drawn = fk.join(totals, ["right_table", "right_column"]).where(place < F.col("share"))
    sizes = drawn.groupBy("right_table", "right_column").agg(F.count("*").alias("sampled"), (F.first("share") == 1).alias("exact"))
    met = drawn.join(pk.where(place < totals.agg(F.max("share")).scalar()), "value").where("left_table != right_table")
    matched = met.groupBy(*_PAIR).agg(F.count("*").alias("matched"))
    margin = F.when(F.col("exact"), 0.0).otherwise(_margin(F.col("sampled")))
    near = matched.join(sizes, ["right_table", "right_column"]).where(F.col("matched") / F.col("sampled") + margin >= min_ratio)
    return near.select(*_PAIR, "sampled", "matched", "exact")


def discover_overlap_sketched(
    frames: dict[str, DataFrame],
    references: list[tuple[str, str]],
    keys: list[tuple[str, str]],
    min_ratio: float = MIN_OVERLAP,
    samples: int = 5,
    sketch: int = SKETCHED_VALUES,
) -> DataFrame:
    """The rows of :func:`discover_overlap`, for catalogs of many columns.

    Where numbers count from 1 nearly every column shares values with every other, so common
    values grow with the square of the columns.  Sketches rule most pairs out first, and a
    value meets only the key columns that its own column may still point to.  Distinct values
    and candidates are stored while the plan is built.  A wanted share that sketches of this
    size cannot tell from nothing takes the plain way.
    """
    if min_ratio <= _margin(sketch):
        return discover_overlap(frames, references, keys, min_ratio, samples)
    fk = stored(_side(column_keys(frames, references), "right"), "reference-values")
    pk = stored(_side(column_keys(frames, keys), "left"), "key-values")
    candidates = stored(overlap_candidates(fk, pk, min_ratio, sketch).select(*_PAIR), "overlap-candidates")
    wanted = fk.join(candidates, ["right_table", "right_column"])
    return _scored_overlap(wanted.join(pk, ["value", "left_table", "left_column"]), fk, min_ratio, samples)


def referenced_name(column_name: Column) -> Column:
    """The table a column's name points to by the first pattern it fits, or NULL."""
    low = F.lower(column_name)
    return F.coalesce(*[F.when(low.rlike(p), F.regexp_extract(low, p, 1)) for p in REFERENCE_PATTERNS])


def discover_names(tables: DataFrame, columns: DataFrame, cross_connection: bool = True) -> DataFrame:
    """Relationships suggested by column names such as ``customer_id``.

    A name leads to one table (the newest when several share it), matched as it is or
    without its plural ending, and to that table's key column.
    """
    name = F.lower("table_name")
    singular = F.array_compact(
        F.array(
            name,
            F.when(name.endswith("s"), F.expr("substring(lower(table_name), 1, length(table_name) - 1)")),
            F.when(name.endswith("es"), F.expr("substring(lower(table_name), 1, length(table_name) - 2)")),
            F.when(name.endswith("ies"), F.expr("concat(substring(lower(table_name), 1, length(table_name) - 3), 'y')")),
        )
    )
    named = (
        tables.select(F.explode(singular).alias("_name"), "table_id", "connection_id")
        .groupBy("_name")
        .agg(F.max(F.struct("table_id", "connection_id")).alias("_t"))
        .select("_name", F.col("_t.table_id").alias("left_table_id"), F.col("_t.connection_id").alias("_left_connection"))
    )
    is_key = F.coalesce("is_primary_key", F.lit(False))
    key_like = is_key | F.lower("column_name").isin(*KEY_NAMES)
    keys = first_per_key(columns.where(key_like), ["table_id"], [is_key.desc(), F.col("column_id")]).select(
        F.col("table_id").alias("_key_table"), F.col("column_id").alias("left_column_id"), F.col("data_type").alias("_key_type")
    )
    references = (
        columns.where(~key_like)
        .withColumn("_ref", referenced_name(F.col("column_name")))
        .where("_ref IS NOT NULL")
        .join(tables.select(F.col("table_id").alias("_own"), F.col("connection_id").alias("_right_connection")), F.col("table_id") == F.col("_own"))
    )
    found = (
        references.join(named, F.col("_ref") == F.col("_name"))
        .where(F.col("left_table_id") != F.col("table_id"))
        .join(keys, F.col("left_table_id") == F.col("_key_table"))
    )
    same = F.col("_left_connection") == F.col("_right_connection")
    if not cross_connection:
        found = found.where(same)
    base = F.when(types_joinable_column(F.col("data_type"), F.col("_key_type")), NAME_SCORE).otherwise(NAME_SCORE_OTHER_TYPE)
    score = F.least(F.round(base + F.when(same, SAME_CONNECTION_BONUS).otherwise(0.0), 4), F.lit(1.0))
    return found.select(
        "left_table_id", "left_column_id", F.col("table_id").alias("right_table_id"),
        F.col("column_id").alias("right_column_id"), F.col("_ref").alias("matched_name"), score.alias("confidence"),
    )


def discover_foreign_keys(columns: DataFrame) -> DataFrame:
    """Relationships the catalog's foreign keys state, with full confidence."""
    keys = columns.select(F.col("column_id").alias("left_column_id"), F.col("table_id").alias("left_table_id"))
    refs = columns.where("is_foreign_key AND fk_column_id IS NOT NULL").select(
        F.col("table_id").alias("right_table_id"), F.col("column_id").alias("right_column_id"), "fk_column_id"
    )
    joined = refs.join(keys, F.col("fk_column_id") == F.col("left_column_id"))
    return joined.select(
        "left_table_id", "left_column_id", "right_table_id", "right_column_id",
        F.lit(1.0).alias("confidence"), F.lit("one_to_many").alias("cardinality"),
    )


def cardinality(left_unique: Column, right_unique: Column) -> Column:
    """Cardinality from whether the key is unique on each side."""
    return (
        F.when(left_unique & right_unique, "one_to_one").when(left_unique, "one_to_many")
        .when(right_unique, "many_to_one").otherwise("many_to_many")
    )


def cardinality_from_flags(relationships: DataFrame, columns: DataFrame) -> DataFrame:
    """Cardinality of each relationship from its columns' primary key flags."""
    out = relationships
    for side in ("left", "right"):
        flags = columns.select(
            F.col("column_id").alias(f"_{side}"), F.coalesce("is_primary_key", F.lit(False)).alias(f"_{side}_key")
        )
        out = out.join(flags, F.col(f"{side}_column_id") == F.col(f"_{side}"), "left")
    unique = [F.coalesce(F.col(f"_{s}_key"), F.lit(False)) for s in ("left", "right")]
    return out.withColumn("cardinality", cardinality(*unique)).drop("_left", "_right", "_left_key", "_right_key")


def measured_cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Cardinality from the data: the most rows any key has on each side."""
    def most(df: DataFrame, key: str) -> Column:
        counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        return counted.agg(F.coalesce(F.max("n"), F.lit(0))).scalar()

    one = left.sparkSession.range(1)
    out = one.select(most(left, left_key).alias("left_max"), most(right, right_key).alias("right_max"))
    return out.withColumn("cardinality", cardinality(F.col("left_max") <= 1, F.col("right_max") <= 1))


def graph_edges(relationships: DataFrame, columns: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Relationship edges with column names."""
    out = relationships if include_inactive else relationships.where("is_active")
    for side in ("left", "right"):
        named = columns.select(F.col("column_id").alias(f"_{side}"), F.col("column_name").alias(f"_{side}_name"))
        out = out.join(named, F.col(f"{side}_column_id") == F.col(f"_{side}"), "left")
        out = out.withColumn(f"{side}_column", F.coalesce(f"_{side}_name", F.lit("unknown")))
    return out.select(
        F.concat(F.lit("rel_"), "relationship_id").alias("id"),
        F.concat(F.lit("table_"), "left_table_id").alias("source"),
        F.concat(F.lit("table_"), "right_table_id").alias("target"),
        "left_column", "right_column",
    )


def graph_nodes(relationships: DataFrame, tables: DataFrame, columns: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Tables in any relationship, with how many columns each has."""
    rel = relationships if include_inactive else relationships.where("is_active")
    ends = rel.select(F.explode(F.array("left_table_id", "right_table_id")).alias("table_id")).distinct()
    counted = columns.groupBy(F.col("table_id").alias("_t")).agg(F.count("*").alias("_n"))
    nodes = tables.join(ends, "table_id", "left_semi").join(counted, F.col("table_id") == F.col("_t"), "left")
    return nodes.select(
        F.concat(F.lit("table_"), "table_id").alias("id"), "table_name", "connection_id",
        F.coalesce("_n", F.lit(0)).alias("column_count"),
    )


def graph_connections(nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """The connections the graph touches."""
    return connections.join(nodes.select("connection_id").distinct(), "connection_id", "left_semi")


def relationship_list(
    relationships: DataFrame,
    tables: DataFrame,
    table_id: int | None = None,
    connection_id: int | None = None,
    status: str | None = None,
    min_confidence: float | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Relationships or suggestions with table names, matched at either end; a page of them by confidence."""
    out = relationships
    for side in ("left", "right"):
        named = tables.select(
            F.col("table_id").alias(f"_{side}"), F.col("table_name").alias(f"{side}_table"),
            F.col("connection_id").alias(f"{side}_connection_id"),
        )
        out = out.join(named, F.col(f"{side}_table_id") == F.col(f"_{side}")).drop(f"_{side}")
    if table_id is not None:
        out = out.where((F.col("left_table_id") == table_id) | (F.col("right_table_id") == table_id))
    if connection_id is not None:
        out = out.where((F.col("left_connection_id") == connection_id) | (F.col("right_connection_id") == connection_id))
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if limit is not None:
        out = out.orderBy(F.col("confidence").desc(), "relationship_id").offset(offset).limit(limit)
    return out


def expand_selection(selected: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Columns that share a group with any column of the selected tables (one step).

    Returns group_id, column_id, table_id and whether the table was selected already.
    """
    chosen = selected.select("table_id").distinct()
    own = columns.join(chosen, "table_id", "left_semi").select("column_id")
    groups = mappings.join(own, "column_id", "left_semi").select("group_id").distinct()
    reached = mappings.join(groups, "group_id", "left_semi").select("group_id", "column_id").distinct()
    marked = chosen.select(F.col("table_id").alias("_chosen"))
    with_table = reached.join(columns.select("column_id", "table_id"), "column_id")
    joined = with_table.join(marked, F.col("table_id") == F.col("_chosen"), "left")
    return joined.select("group_id", "column_id", "table_id", F.col("_chosen").isNotNull().alias("was_selected"))


def resolve_scope(tables: DataFrame, connections: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """The explicitly listed tables, or all tables of the connections when none are listed."""
    if explicit is not None and not explicit.isEmpty():
        return tables.join(explicit.select("table_id").distinct(), "table_id", "left_semi")
    return tables.join(connections.select("connection_id").distinct(), "connection_id", "left_semi")


def unmapped_columns(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Columns in no group."""
    return columns.join(mappings.select("column_id").distinct(), "column_id", "left_anti")
