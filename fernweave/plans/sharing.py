"""Shared data: file state from an action log, change feeds, read-only SQL."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.operators.digests import differing_rows
from fernweave.operators.predicates import predicate_tree
from fernweave.sources.snapshots import read_snapshot

QUERY_CAP = 10_000


class NoSuchVersion(ValueError):
    pass


def replay_log(actions: DataFrame, path: str, action: str, order: list[str], version: int | None = None) -> DataFrame:
    """Paths whose last action up to the version is ``add``.

    ``order`` starts with the version column.  A version beyond the log is an error.
    """
    if version is not None:
        newest = actions.agg(F.max(order[0])).first()[0]
        if newest is None or version > newest:
            raise NoSuchVersion(f"version {version} does not exist; the latest is {newest}")
        actions = actions.where(F.col(order[0]) <= version)
    last = actions.groupBy(path).agg(F.max_by(action, F.struct(*order)).alias("_last"))
    return last.where("_last = 'add'").select(path)


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Changes from one snapshot to the next: insert, delete, update_pre and update_post rows."""
    columns = old.columns
    before = old.select(F.col(key).alias("_old_key"), F.struct(*columns).alias("_before"))
    after = new.select(F.col(key).alias("_new_key"), F.struct(*columns).alias("_after"))
    joined = before.join(after, F.col("_old_key") == F.col("_new_key"), "full")

    def differs(field: T.StructField) -> Column:
        a, b = F.col(f"_before.`{field.name}`"), F.col(f"_after.`{field.name}`")
        if isinstance(field.dataType, T.MapType):  # maps have no equality of their own
            a, b = F.to_json(a), F.to_json(b)
        return ~a.eqNullSafe(b)

    def change(kind: str, row: str) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("_row"))

    changes = (
        F.when(F.col("_old_key").isNull(), F.array(change("insert", "_after")))
        .when(F.col("_new_key").isNull(), F.array(change("delete", "_before")))
        .when(
            reduce(operator.or_, [differs(f) for f in old.schema]),
            F.array(change("update_pre", "_before"), change("update_post", "_after")),
        )
    )
    return joined.select(F.explode(changes).alias("_c")).select("_c._change_type", "_c._row.*")


def table_changes(spark: SparkSession, path: str, start: int, end: int, key: str, buckets: int | None = None) -> DataFrame:
    """The change feed between two versions of a stored table; with ``buckets``, only key buckets that differ are joined."""
    old, new = read_snapshot(spark, path, start), read_snapshot(spark, path, end)
    if buckets:
        old, new = differing_rows(old, new, key, old.columns, buckets)
    return change_feed(old, new, key)


#: Functions that run any method of the JVM or read what is no view.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}
#: Leaves of an analysed query that hold no stored rows.
HARMLESS_LEAVES = {"OneRowRelation", "Range", "LocalRelation", "CTERelationRef"}
#: Functions that may stand in place of a table.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "stack"}


def _sequence(found: object) -> list:
    return [found.apply(i) for i in range(found.size())]


def _only_views(spark: SparkSession, query: str) -> None:
    """Raise unless every relation of the parsed query is a temporary view and every function harmless."""
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
    nodes, relations, named = [parsed], [], set()
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relations.append([str(p).lower() for p in _sequence(node.multipartIdentifier())])
        elif "UnresolvedIdentifier" in kind or kind == "RelationTimeTravel":
            raise ValueError("only names of registered views can be read")
        elif kind == "UnresolvedTableValuedFunction" and str(_sequence(node.name())[-1]).lower() not in TABLE_FUNCTIONS:
            raise ValueError("this table function is not allowed")
        elif kind == "UnresolvedFunction" and str(_sequence(node.nameParts())[-1]).lower() in FORBIDDEN_FUNCTIONS:
            raise ValueError("this function is not allowed")
        elif kind == "SubqueryAlias":
            named.add(str(node.alias()).lower())
        below = _sequence(node.children()) + _sequence(node.innerChildren())
        if "catalyst.plans.logical" in node.getClass().getName() or kind.startswith("Unresolved") and "Relation" in kind:
            below += _sequence(node.expressions())
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            below.append(node.plan())
        nodes += below
    for name in relations:
        if len(name) != 1 or name[0] not in views | named:
            raise ValueError(f"no registered view {'.'.join(name)}")


def _check_leaves(rows: DataFrame) -> None:
    """Raise unless all rows of the analysed query come from temporary views.

    An alias may make a name look registered; here every name has been resolved, so what was
    read is seen, below subqueries and common table expressions too.
    """
    nodes = [rows._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View" and node.isTempView():
            continue
        below = _sequence(node.children()) + _sequence(node.innerChildren())
        if "catalyst.plans.logical" in node.getClass().getName():
            below += _sequence(node.expressions())
            if not node.children().size() and kind not in HARMLESS_LEAVES:
                raise ValueError("only registered views can be read")
        elif "execution" in node.getClass().getName() or kind.endswith("Relation"):
            raise ValueError("only registered views can be read")
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            below.append(node.plan())
        nodes += below


def read_only_query(spark: SparkSession, query: str, cap: int = QUERY_CAP) -> DataFrame:
    """At most ``cap`` rows of a query over registered views, each with ``truncated``.

    The text is used as a subquery, where only a query parses: commands and statement
    lists are rejected before anything runs.  So are relations that are no temporary view
    (files, stored tables), identifiers made up at run time, and functions that call Java or
    name files.  The analysed query is looked at again, with all names resolved.
    """
    _only_views(spark, query)
    rows = spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)")
    _check_leaves(rows)
    more = rows.limit(cap + 1).agg(F.count("*") > cap).scalar()
    return rows.limit(cap).withColumn("truncated", more)


def live_grants(recipients: DataFrame, grants: DataFrame, shares: DataFrame) -> DataFrame:
    """Grants of active recipients to active shares: recipient_id, share_id.

    ``recipients``: recipient_id, is_active; ``grants``: recipient_id, share_id; ``shares``:
    share_id, is_active.
    """
    granted = grants.join(recipients.where("is_active").select("recipient_id").distinct(), "recipient_id", "left_semi")
    live = granted.join(shares.where("is_active").select("share_id").distinct(), "share_id", "left_semi")
    return live.select("recipient_id", "share_id").distinct()


def accessible_tables(grants: DataFrame, tables: DataFrame, recipient_id: int) -> DataFrame:
    """Tables one recipient may read: ``grants`` from :func:`live_grants`, ``tables``: share_id, table_id."""
    mine = grants.where(F.col("recipient_id") == recipient_id).select("share_id")
    return tables.join(mine, "share_id", "left_semi").select("table_id").distinct()


def shared_rows(
    spark: SparkSession,
    path: str,
    predicate: dict | None = None,
    limit: int | None = None,
    version: int | None = None,
    pinned: int | None = None,
) -> DataFrame:
    """Rows of a shared table: a pinned version wins over the requested one; filter and limit are optional."""
    df = read_snapshot(spark, path, version=version, pinned=pinned)
    if predicate:
        df = df.where(predicate_tree(df, predicate))
    return df if limit is None else df.limit(limit)
