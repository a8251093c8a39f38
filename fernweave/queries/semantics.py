"""Relationships, groups and value maps over a catalog derived from the given tables.

Customers stand for tables, nations for connections, orders for columns, lines for
mappings and relationships, so every catalog query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators import aggregates, joins, predicates, semantics
from fernweave.operators.joins import unlinked_tables as find_unlinked
from fernweave.plans import discovery, unify
from fernweave.queries.registry import Tables, query

CATALOG = """
tables AS (SELECT c_custkey AS table_id, 't' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 'es' WHEN 2 THEN 'ies' ELSE '' END AS table_name, c_nationkey AS connection_id FROM customer),
columns AS (SELECT o_orderkey AS column_id, o_custkey AS table_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'id' WHEN 1 THEN 't' || k || '_id' WHEN 2 THEN 'id_t' || k WHEN 3 THEN 'fk_T' || k WHEN 4 THEN 't' || k || '_fk' WHEN 5 THEN 't' || k || '_key' WHEN 6 THEN 'ref_t' || k WHEN 7 THEN 't' || k || 'y_id' ELSE 'note' END AS column_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'int' WHEN '2-HIGH' THEN 'bigint' WHEN '3-MEDIUM' THEN 'varchar' WHEN '4-NOT SPECIFIED' THEN 'text' ELSE 'uuid' END AS data_type,
  o_orderstatus = 'P' AS is_primary_key, o_orderstatus = 'F' AS is_foreign_key, k AS fk_column_id
  FROM (SELECT *, floor(o_totalprice)::BIGINT % 150 AS k FROM orders)),
mappings AS (SELECT DISTINCT l_partkey AS group_id, l_orderkey AS column_id FROM lineitem),
relationships AS (SELECT l_orderkey * 1000000 + l_partkey AS relationship_id, l_orderkey AS left_column_id, l_partkey AS right_column_id, x.table_id AS left_table_id, y.table_id AS right_table_id, confidence, is_active, status
  FROM (SELECT l_orderkey, l_partkey, round(0.5 + max(l_discount) * 4, 2) AS confidence, max(l_returnflag) <> 'N' AS is_active, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)
  JOIN columns x ON x.column_id = l_orderkey JOIN columns y ON y.column_id = l_partkey)
"""


def tables(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    ending = F.when(key % 4 == 0, "s").when(key % 4 == 1, "es").when(key % 4 == 2, "ies").otherwise("")
    return t.customer.select(key.alias("table_id"), F.concat(F.lit("t"), key, ending).alias("table_name"), F.col("c_nationkey").alias("connection_id"))


def columns(t: Tables) -> DataFrame:
    k = F.floor("o_totalprice") % 150
    forms = [F.lit("id"), ("t", "_id"), ("id_t", ""), ("fk_T", ""), ("t", "_fk"), ("t", "_key"), ("ref_t", ""), ("t", "y_id"), F.lit("note")]
    name = None
    for i, form in enumerate(forms):
        value = F.concat(F.lit(form[0]), k, F.lit(form[1])) if isinstance(form, tuple) else form
        test = F.col("o_orderkey") % 9 == i
        name = F.when(test, value) if name is None else name.when(test, value)
    kinds = {"1-URGENT": "int", "2-HIGH": "bigint", "3-MEDIUM": "varchar", "4-NOT SPECIFIED": "text"}
    return t.orders.select(
        F.col("o_orderkey").alias("column_id"), F.col("o_custkey").alias("table_id"), name.alias("column_name"),
        semantics.map_values(F.col("o_orderpriority"), kinds, "uuid").alias("data_type"),
        (F.col("o_orderstatus") == "P").alias("is_primary_key"), (F.col("o_orderstatus") == "F").alias("is_foreign_key"),
        k.alias("fk_column_id"),
    )


def mappings(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("group_id"), F.col("l_orderkey").alias("column_id")).distinct()


def relationships(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy(F.col("l_orderkey").alias("left_column_id"), F.col("l_partkey").alias("right_column_id")).agg(
        F.round(0.5 + F.max("l_discount") * 4, 2).alias("confidence"),
        (F.bool_or(F.col("l_returnflag") == "R") | F.bool_and(F.col("l_returnflag") == "A")).alias("is_active"),
        F.when(F.bool_or(F.col("l_linestatus") == "O"), "O").otherwise("F").alias("status"),
    )
    owner = columns(t).select("column_id", "table_id")
    left = owner.select(F.col("column_id").alias("left_column_id"), F.col("table_id").alias("left_table_id"))
    right = owner.select(F.col("column_id").alias("right_column_id"), F.col("table_id").alias("right_table_id"))
    identity = (F.col("left_column_id") * 1000000 + F.col("right_column_id")).alias("relationship_id")
    return pairs.join(left, "left_column_id").join(right, "right_column_id").select(identity, "*")


def _catalog(sql: str) -> str:
    return f"WITH {CATALOG} {sql}"


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE 'later' END AS priority FROM orders
""")
def value_mapping(t: Tables) -> DataFrame:
    status = semantics.map_values(F.col("o_orderstatus"), {"O": "open", "F": "finished"})
    return t.orders.select("o_orderkey", status.alias("status"), semantics.map_values(F.col("o_orderpriority"), {"1-URGENT": "now"}, "later").alias("priority"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, coalesce(s_name, l_suppkey::VARCHAR) AS supplier FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey + 20
""")
def value_mapping_table(t: Tables) -> DataFrame:
    """Value map held in a table of any size."""
    mapping = t.supplier.select((F.col("s_suppkey") + 20).cast("string").alias("source_value"), F.col("s_name").alias("standard_value"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey")
    return semantics.map_values_table(lines, "l_suppkey", mapping, "supplier").drop("l_suppkey")


@query("""
SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nation, coalesce(s_acctbal, c_acctbal) AS balance FROM
(SELECT c_custkey + 50 AS c_custkey, c_nationkey, c_acctbal FROM customer) c FULL JOIN supplier ON c_custkey = s_suppkey
""")
def column_unification(t: Tables) -> DataFrame:
    """The first value present, in mapping order, then the sources are dropped."""
    customer = t.customer.select((F.col("c_custkey") + 50).alias("c_custkey"), "c_nationkey", "c_acctbal")
    joined = joins.keyed_join(customer, t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), [("c_custkey", "s_suppkey")], "full")
    return joined.select(
        "c_custkey", "s_suppkey", semantics.unify([F.col("c_nationkey"), F.col("s_nationkey")]).alias("nation"),
        semantics.unify([F.col("s_acctbal"), F.col("c_acctbal")]).alias("balance"),
    )


@query("""
SELECT l_partkey AS group_id, l_returnflag AS standard_value, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size < 40 AND NOT (l_returnflag = 'A' OR (p_size > 25 AND l_returnflag = 'R'))
""")
def nonstandard_values(t: Tables) -> DataFrame:
    """Mapped values that their group's dictionary does not list; some groups have no list."""
    size, none = F.col("p_size"), F.array().cast("array<string>")
    values = F.when(size >= 40, none).when(size > 25, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("A")))
    listed = t.part.select(F.col("p_partkey").alias("group_id"), values.alias("standard_values"))
    used = t.lineitem.select(F.col("l_partkey").alias("group_id"), F.col("l_returnflag").alias("standard_value"), "l_orderkey")
    return semantics.nonstandard_values(used, listed).select("group_id", "standard_value", "l_orderkey")


_OVERLAP = """
SELECT '{lt}' AS left_table, '{lc}' AS left_column, '{rt}' AS right_table, '{rc}' AS right_column, hit AS overlap_count,
 round(hit / total, 6) AS overlap_ratio, round(0.5 + hit / total * 0.4, 6) AS confidence, samples AS sample_matches FROM (
 SELECT (SELECT count(DISTINCT {rc}) FROM {rt}) AS total, (SELECT count(DISTINCT {rc}) FROM {rt} WHERE {rc} IN (SELECT {lc} FROM {lt})) AS hit,
 (SELECT to_json(list(v ORDER BY v))::VARCHAR FROM (SELECT DISTINCT {rc}::VARCHAR AS v FROM {rt} WHERE {rc} IN (SELECT {lc} FROM {lt}) ORDER BY 1 LIMIT 5)) AS samples)
WHERE hit / total >= 0.3
"""
_REFS = [("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("customer", "c_nationkey")]
_PKS = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")]


_OVERLAPS = " UNION ALL ".join(_OVERLAP.format(lt=lt, lc=lc, rt=rt, rc=rc) for rt, rc in _REFS for lt, lc in _PKS if lt != rt)


@query(_OVERLAPS)
def discover_by_overlap(t: Tables) -> DataFrame:
    """Which columns hold the keys of which tables, by their values."""
    frames = {n: getattr(t, n) for n in ("customer", "orders", "part", "supplier", "nation", "lineitem")}
    found = semantics.discover_overlap(frames, _REFS, _PKS)
    return found.withColumns({"overlap_ratio": F.round("overlap_ratio", 6), "confidence": F.round("confidence", 6)})


@query(_OVERLAPS)
def discover_by_overlap_sketched(t: Tables) -> DataFrame:
    """The same, with pairs ruled out by sketches of a thousand values before anything is counted in full."""
    frames = {n: getattr(t, n) for n in ("customer", "orders", "part", "supplier", "nation", "lineitem")}
    found = semantics.discover_overlap_sketched(frames, _REFS, _PKS, sketch=1000)
    return found.withColumns({"overlap_ratio": F.round("overlap_ratio", 6), "confidence": F.round("confidence", 6)})


_BY_NAME = """
, keyed AS (SELECT *, is_primary_key OR column_name IN ('id', 'pk', 'key', 'code', 'numero', 'codigo') AS k FROM columns),
keys AS (SELECT * FROM keyed WHERE k QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY is_primary_key DESC, column_id) = 1),
refs AS (SELECT k.*, t.connection_id, CASE WHEN lower(column_name) LIKE '%_\\_id' ESCAPE '\\' THEN regexp_extract(lower(column_name), '^(.+)_id$', 1)
  WHEN lower(column_name) LIKE 'id\\__%' ESCAPE '\\' THEN substring(lower(column_name), 4) WHEN lower(column_name) LIKE 'fk\\__%' ESCAPE '\\' THEN substring(lower(column_name), 4)
  WHEN lower(column_name) LIKE '%_\\_fk' ESCAPE '\\' THEN regexp_extract(lower(column_name), '^(.+)_fk$', 1) WHEN lower(column_name) LIKE '%_\\_key' ESCAPE '\\' THEN regexp_extract(lower(column_name), '^(.+)_key$', 1)
  WHEN lower(column_name) LIKE 'ref\\__%' ESCAPE '\\' THEN substring(lower(column_name), 5) END AS ref FROM keyed k JOIN tables t ON t.table_id = k.table_id WHERE NOT k),
variants AS (SELECT table_name AS v, table_id, connection_id FROM tables UNION ALL SELECT substring(table_name, 1, length(table_name) - 1), table_id, connection_id FROM tables WHERE table_name LIKE '%s'
  UNION ALL SELECT substring(table_name, 1, length(table_name) - 2), table_id, connection_id FROM tables WHERE table_name LIKE '%es'
  UNION ALL SELECT substring(table_name, 1, length(table_name) - 3) || 'y', table_id, connection_id FROM tables WHERE table_name LIKE '%ies'),
named AS (SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY v ORDER BY table_id DESC) = 1)
SELECT n.table_id AS left_table_id, p.column_id AS left_column_id, r.table_id AS right_table_id, r.column_id AS right_column_id, r.ref AS matched_name,
 least(round((CASE WHEN r.data_type = p.data_type OR (r.data_type IN ('int', 'bigint') AND p.data_type IN ('int', 'bigint')) OR (r.data_type IN ('varchar', 'text') AND p.data_type IN ('varchar', 'text')) THEN 0.85 ELSE 0.6 END
  + CASE WHEN n.connection_id = r.connection_id THEN 0.1 ELSE 0 END)::DOUBLE, 4), 1.0)::DOUBLE AS confidence
FROM refs r JOIN named n ON n.v = r.ref JOIN keys p ON p.table_id = n.table_id WHERE n.table_id <> r.table_id
"""


@query(_catalog(_BY_NAME))
def discover_by_name(t: Tables) -> DataFrame:
    return semantics.discover_names(tables(t), columns(t))


@query(_catalog("""
SELECT p.table_id AS left_table_id, p.column_id AS left_column_id, c.table_id AS right_table_id, c.column_id AS right_column_id, 1.0::DOUBLE AS confidence, 'one_to_many' AS cardinality
FROM columns c JOIN columns p ON p.column_id = c.fk_column_id WHERE c.is_foreign_key
"""))
def discover_by_foreign_key(t: Tables) -> DataFrame:
    return semantics.discover_foreign_keys(columns(t))


_NAME_PARTS = _BY_NAME.split("SELECT n.table_id AS left_table_id", 1)


@query(_catalog(f"""{_NAME_PARTS[0]}, by_name AS (SELECT n.table_id AS left_table_id{_NAME_PARTS[1]}),
found AS (SELECT left_table_id, left_column_id, right_table_id, right_column_id, confidence, 'name' AS source FROM by_name
  UNION ALL SELECT p.table_id, p.column_id, c.table_id, c.column_id, 1.0, 'foreign_key' FROM columns c JOIN columns p ON p.column_id = c.fk_column_id WHERE c.is_foreign_key)
SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM relationships x WHERE least(x.left_column_id, x.right_column_id) = least(f.left_column_id, f.right_column_id)
  AND greatest(x.left_column_id, x.right_column_id) = greatest(f.left_column_id, f.right_column_id))
QUALIFY row_number() OVER (PARTITION BY least(left_column_id, right_column_id), greatest(left_column_id, right_column_id) ORDER BY confidence DESC, source, left_column_id, right_column_id) = 1
"""))
def suggested_relationships(t: Tables) -> DataFrame:
    """All methods together: best per pair, known relationships left out."""
    return discovery.suggest_relationships(tables(t), columns(t), relationships(t))


@query(_catalog("""
SELECT relationship_id, CASE WHEN x.is_primary_key AND y.is_primary_key THEN 'one_to_one' WHEN x.is_primary_key THEN 'one_to_many' WHEN y.is_primary_key THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality
FROM relationships r JOIN columns x ON x.column_id = r.left_column_id JOIN columns y ON y.column_id = r.right_column_id
"""))
def cardinality_from_flags(t: Tables) -> DataFrame:
    return semantics.cardinality_from_flags(relationships(t), columns(t)).select("relationship_id", "cardinality")


@query("""
SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey)) AS left_max, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS right_max, 'one_to_many' AS cardinality
""")
def measured_cardinality(t: Tables) -> DataFrame:
    return semantics.measured_cardinality(t.customer, "c_custkey", t.orders, "o_custkey")


@query(_catalog("""
SELECT 'rel_' || relationship_id AS id, 'table_' || left_table_id AS source, 'table_' || right_table_id AS target, x.column_name AS left_column, y.column_name AS right_column
FROM relationships r JOIN columns x ON x.column_id = r.left_column_id JOIN columns y ON y.column_id = r.right_column_id WHERE is_active
"""))
def graph_edges(t: Tables) -> DataFrame:
    return semantics.graph_edges(relationships(t), columns(t))


@query(_catalog("""
SELECT 'table_' || table_id AS id, table_name, connection_id, (SELECT count(*) FROM columns c WHERE c.table_id = t.table_id) AS column_count FROM tables t
WHERE table_id IN (SELECT left_table_id FROM relationships WHERE is_active) OR table_id IN (SELECT right_table_id FROM relationships WHERE is_active)
"""))
def graph_nodes(t: Tables) -> DataFrame:
    return semantics.graph_nodes(relationships(t), tables(t), columns(t))


@query(_catalog("""
SELECT n_nationkey AS connection_id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT connection_id FROM tables
 WHERE table_id IN (SELECT left_table_id FROM relationships WHERE is_active) OR table_id IN (SELECT right_table_id FROM relationships WHERE is_active))
"""))
def graph_connections(t: Tables) -> DataFrame:
    nodes = semantics.graph_nodes(relationships(t), tables(t), columns(t))
    return semantics.graph_connections(nodes, t.nation.select(F.col("n_nationkey").alias("connection_id"), F.col("n_name").alias("name")))


@query(_catalog("""
SELECT relationship_id, x.table_name AS left_table, y.table_name AS right_table, confidence FROM relationships r JOIN tables x ON x.table_id = left_table_id JOIN tables y ON y.table_id = right_table_id
WHERE (x.connection_id = 7 OR y.connection_id = 7) AND status = 'O' AND confidence >= 0.6 ORDER BY confidence DESC, relationship_id OFFSET 5 LIMIT 50
"""))
def relationship_list(t: Tables) -> DataFrame:
    found = semantics.relationship_list(relationships(t), tables(t), connection_id=7, status="O", min_confidence=0.6, offset=5, limit=50)
    return found.select("relationship_id", "left_table", "right_table", "confidence")


@query(_catalog("""
SELECT relationship_id, left_table_id, right_table_id, CASE WHEN x.connection_id = y.connection_id THEN 'intra' ELSE 'inter' END AS scope
FROM relationships JOIN tables x ON x.table_id = left_table_id JOIN tables y ON y.table_id = right_table_id WHERE is_active AND x.connection_id < 15 AND y.connection_id < 15
"""))
def relationship_scope(t: Tables) -> DataFrame:
    """Relationships inside a selection of tables, split by whether they cross connections."""
    out = joins.split_scope(relationships(t), tables(t).where("connection_id < 15"))
    return out.select("relationship_id", "left_table_id", "right_table_id", "scope")


@query(_catalog("""
SELECT DISTINCT group_id, m.column_id, c.table_id, t.connection_id = 3 AS was_selected FROM mappings m JOIN columns c ON c.column_id = m.column_id JOIN tables t ON t.table_id = c.table_id
WHERE group_id IN (SELECT group_id FROM mappings m2 JOIN columns c2 ON c2.column_id = m2.column_id JOIN tables t2 ON t2.table_id = c2.table_id WHERE t2.connection_id = 3)
"""))
def expand_selection(t: Tables) -> DataFrame:
    """Columns and tables reached from the tables of one connection through shared groups."""
    return semantics.expand_selection(tables(t).where("connection_id = 3"), columns(t), mappings(t))


@query(_catalog("""SELECT table_id, table_name, connection_id FROM tables WHERE connection_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"""))
def scope_by_connection(t: Tables) -> DataFrame:
    """Without an explicit list, all tables of the named connections."""
    wanted = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("connection_id"))
    return semantics.resolve_scope(tables(t), wanted, t.orders.where("o_totalprice < 0").select(F.col("o_custkey").alias("table_id")))


@query(_catalog("""SELECT table_id, table_name, connection_id FROM tables WHERE table_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""))
def scope_by_list(t: Tables) -> DataFrame:
    wanted = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("table_id"))
    return semantics.resolve_scope(tables(t), t.nation.select(F.col("n_nationkey").alias("connection_id")), wanted)


@query(_catalog("""
SELECT NULL AS data_type, count(*) AS total_columns, count(*) FILTER (column_id IN (SELECT column_id FROM mappings)) AS mapped_columns, round(count(*) FILTER (column_id IN (SELECT column_id FROM mappings)) * 100.0 / count(*), 2)::DOUBLE AS coverage_percentage FROM columns
UNION ALL SELECT data_type, count(*), count(*) FILTER (column_id IN (SELECT column_id FROM mappings)), round(count(*) FILTER (column_id IN (SELECT column_id FROM mappings)) * 100.0 / count(*), 2)::DOUBLE FROM columns GROUP BY data_type
"""))
def mapping_coverage(t: Tables) -> DataFrame:
    return aggregates.mapping_coverage(columns(t), mappings(t))


@query(_catalog("""SELECT column_id, table_id, column_name, data_type FROM columns WHERE column_id NOT IN (SELECT column_id FROM mappings) AND (column_name ILIKE '%ID%' OR data_type ILIKE '%id%')"""))
def unmapped_columns(t: Tables) -> DataFrame:
    """Unmapped columns by keyword."""
    left = semantics.unmapped_columns(columns(t).select("column_id", "table_id", "column_name", "data_type"), mappings(t))
    return predicates.keyword_search(left, "id", ["column_name", "data_type"])


@query(_catalog("""
SELECT table_id, count(*) AS total_columns, count(m) AS mapped_columns, count(*) - count(m) AS individual_columns, round(count(m) * 100.0 / count(*), 2)::DOUBLE AS mapped_percentage
FROM columns c LEFT JOIN (SELECT DISTINCT column_id AS m FROM mappings) ON m = c.column_id WHERE table_id IN (SELECT table_id FROM tables WHERE connection_id < 5) GROUP BY 1
"""))
def unify_preview(t: Tables) -> DataFrame:
    return unify.unify_preview(tables(t).where("connection_id < 5"), columns(t), mappings(t))


@query(_catalog("""
, chosen AS (SELECT column_id FROM columns WHERE table_id IN (SELECT table_id FROM tables WHERE connection_id < 5))
SELECT g AS mapped_groups, i AS individual_columns, g + i AS estimated_columns FROM (SELECT
 (SELECT count(DISTINCT group_id) FROM mappings WHERE column_id IN (SELECT column_id FROM chosen)) AS g, (SELECT count(*) FROM chosen WHERE column_id NOT IN (SELECT column_id FROM mappings)) AS i)
"""))
def unify_estimate(t: Tables) -> DataFrame:
    return unify.estimated_columns(tables(t).where("connection_id < 5"), columns(t), mappings(t))


@query(_catalog("""
SELECT DISTINCT l_partkey AS table_id, CASE WHEN l_partkey NOT IN (SELECT table_id FROM tables WHERE connection_id <> 2) THEN 'missing table' ELSE 'no columns' END AS problem FROM lineitem
WHERE l_partkey NOT IN (SELECT table_id FROM tables WHERE connection_id <> 2) OR l_partkey NOT IN (SELECT table_id FROM columns WHERE data_type = 'uuid')
"""))
def unify_compatibility(t: Tables) -> DataFrame:
    """Selected tables (here the part numbers of all lines) that the catalog cannot unify."""
    selected = t.lineitem.select(F.col("l_partkey").alias("table_id"))
    return unify.compatibility(selected, tables(t).where("connection_id != 2"), columns(t).where("data_type = 'uuid'"))


@query("SELECT 'part' AS table_name, count(*) AS row_count FROM part")
def unlinked_tables(t: Tables) -> DataFrame:
    """Tables no relationship reaches are reported with their size, never multiplied out."""
    from fernweave.queries.flows import RELATIONSHIPS

    linked = [r for r in RELATIONSHIPS if r.right_table != "part"]
    names = find_unlinked(["customer", "orders", "nation", "region", "supplier", "lineitem", "part"], linked)
    counts = None
    for name in names:
        part = getattr(t, name).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = part if counts is None else counts.unionByName(part)
    return counts
