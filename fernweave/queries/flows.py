"""Whole transformations: bronze plan, silver, virtual view, unified dataset, extraction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.config import ColumnGroup, Extraction, Relationship, SilverConfig, Transformation
from fernweave.operators.joins import membership_flag, name_lookup
from fernweave.plans import bronze, extract, silver, transform, unify
from fernweave.queries.registry import Tables, query
from fernweave.sinks.snapshots import write_snapshot
from fernweave.sinks.tables import read_batches
from fernweave.sources.snapshots import read_snapshot

AT = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
STATUS = {"O": "open", "F": "finished"}

LINKS = [
    Relationship("customer", "c_custkey", "orders", "o_custkey", "full", cardinality="one_to_many"),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey", "left", cardinality="many_to_one"),
]

FLAGSHIP = SilverConfig(
    id=7,
    filters={
        "logic": "AND",
        "conditions": [
            {"column_name": "o_totalprice", "operator": ">", "value": "1000"},
            {"column_name": "status", "operator": "IN", "value": '["open", "P"]'},
            {"column_id": 11, "operator": "LIKE", "value": "CUSTOMER%"},
        ],
    },
    groups=(ColumnGroup("status", ("o_orderstatus",), {"o_orderstatus": STATUS}),),
    transformations=(Transformation(11, "normalize_spaces"), Transformation(11, "uppercase")),
    drop_unified_sources=True,
    column_ids={11: "c_name", 12: "o_orderstatus"},
)

FLAGSHIP_SQL = """
WITH joined AS (
  SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey, coalesce(c.c_nationkey, n.n_nationkey) AS c_nationkey,
         c.c_name, c.c_acctbal, c.c_mktsegment, o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
         o.o_orderpriority, n.n_name, n.n_regionkey
  FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_totalprice > 1000
), changed AS (
  SELECT c_custkey, c_nationkey, upper(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS c_name, c_acctbal, c_mktsegment,
         o_orderkey, o_totalprice, o_orderdate, o_orderpriority, n_name, n_regionkey,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS status
  FROM joined
)
SELECT * FROM changed WHERE status IN ('open', 'P') AND c_name LIKE 'CUSTOMER%'
"""


def _sources(t: Tables) -> dict[str, DataFrame]:
    return {"customer": t.customer, "orders": t.orders, "nation": t.nation}


@query(FLAGSHIP_SQL)
def virtual_view(t: Tables) -> DataFrame:
    return silver.virtual_view(_sources(t), LINKS, FLAGSHIP)


@query(FLAGSHIP_SQL.replace("SELECT * FROM changed", "SELECT *, 7 AS _transform_config_id FROM changed"))
def silver_flagship(t: Tables) -> DataFrame:
    """Joined, filtered, mapped, changed and stamped; written as a snapshot and read back."""
    result = silver.transform(silver.combine_sources(_sources(t), LINKS, config=FLAGSHIP), FLAGSHIP, at=AT)
    path = t.scratch("silver")
    write_snapshot(result, path, config={"id": FLAGSHIP.id}, at=AT)
    return read_snapshot(t.spark, path).drop("_silver_timestamp")


@query("""
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS balance, NULL::INTEGER AS extra, 'x' AS kind, 9 AS _transform_config_id
FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, s_nationkey, 'y', 9 FROM supplier WHERE s_acctbal >= 0
""")
def silver_union(t: Tables) -> DataFrame:
    """Sources without links are stacked."""
    customer = t.customer.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("balance"), F.lit("x").alias("kind"),
    )
    supplier = t.supplier.select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("balance"), F.lit("y").alias("kind"), F.col("s_nationkey").alias("extra"),
    )
    config = SilverConfig(9, filters={"conditions": [{"column_name": "balance", "operator": ">=", "value": 0}]})
    stacked = silver.combine_sources({"customer": customer, "supplier": supplier}, None)
    return silver.transform(stacked, config, at=AT).drop("_silver_timestamp")


@query("""
SELECT p_partkey, upper(trim(p_name)) AS p_name, lower(p_brand) AS p_brand, p_type, p_size, p_retailprice FROM part
""")
def column_transformations(t: Tables) -> DataFrame:
    steps = (
        Transformation("p_name", "trim"),
        Transformation("p_name", "uppercase"),
        Transformation(3, "lowercase"),
        Transformation("no_such_column", "lowercase"),
    )
    return transform.transform_columns(t.part, steps, {3: "p_brand"})


@query("""
SELECT c_custkey, regexp_replace(c_name, '^Customer#0*([0-9])', 'C-\\1') AS c_name,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment
FROM customer
""")
def regex_and_case_rules(t: Tables) -> DataFrame:
    steps = (
        Transformation("c_name", "sql_regex", ("^Customer#0*([0-9])", "C-$1")),
        Transformation("c_mktsegment", "case_mapping", (("MACHINERY", "M"), ("BUILDING", "B"))),
    )
    return transform.transform_columns(t.customer.select("c_custkey", "c_name", "c_mktsegment"), steps)


@query("SELECT c_custkey, reverse(c_name) AS c_name FROM customer")
def python_rule(t: Tables) -> DataFrame:
    """A user's Python rule, run on Arrow batches."""
    steps = (Transformation("c_name", "python_rule", lambda value: value[::-1]),)
    return transform.transform_columns(t.customer.select("c_custkey", "c_name"), steps)


@query("""
SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL ELSE contains(lower(text), 'http') OR contains(lower(text), 'www') END AS has_link
FROM documents
""")
def extract_flag(t: Tables) -> DataFrame:
    extraction = Extraction("text", "has_link")
    found = extract.extract_column(t.documents.select("doc_id", "text"), extraction, extract.keyword_flag(["http", "www"]))
    return found.drop("text")


@query("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'english' WHEN contains(lower(text), 'que') THEN 'romance' ELSE 'other' END AS tongue
FROM conversations WHERE trim(text) <> '' AND (contains(lower(text), 'the') OR contains(lower(text), 'que'))
""")
def extract_choice_then_filter(t: Tables) -> DataFrame:
    """A filter on an extracted column runs after the extraction."""
    config = SilverConfig(
        3,
        filters={"conditions": [{"column_name": "tongue", "operator": "!=", "value": "other"}]},
        extractions=(Extraction("text", "tongue", ("english", "romance", "other")),),
    )
    chooser = extract.keyword_choice({"english": ["the"], "romance": ["que"]}, "other")
    out = silver.transform(t.conversations, config, {"tongue": chooser}, AT)
    return out.select("conv_id", "turn", "tongue")


CONNECTIONS = {"customer": "one", "orders": "one", "nation": "one", "region": "one", "supplier": "two", "lineitem": "two", "part": "two"}
RELATIONSHIPS = [
    Relationship("customer", "c_custkey", "orders", "o_custkey", "left"),
    Relationship("nation", "n_nationkey", "customer", "c_nationkey", "inner"),
    Relationship("region", "r_regionkey", "nation", "n_regionkey", "inner"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey", "inner"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey", "inner"),
    Relationship("orders", "o_orderkey", "lineitem", "l_orderkey", "full"),
]


def _bronze_frames(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in CONNECTIONS}


@query("""
SELECT 'part_one' AS group_name, count(*) AS row_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'part_two', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")
def bronze_plan(t: Tables) -> DataFrame:
    """One group per connection and component, each counted from its lazily joined rows."""
    frames, plan = _bronze_frames(t), bronze.plan_bronze(CONNECTIONS, RELATIONSHIPS)
    counts = [
        bronze.build_group(frames, g, at=AT)[0].agg(F.count("*").alias("row_count")).select(F.lit(g.name).alias("group_name"), "row_count")
        for g in plan.groups
    ]
    return counts[0].unionByName(counts[1])


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, p_name, s_name, 'lineitem' AS _source_table
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")
def bronze_run(t: Tables) -> DataFrame:
    """Every group written under its own name; one of them read back."""
    columns = {
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
        "part": ["p_partkey", "p_name"],
        "supplier": ["s_suppkey", "s_name"],
        "orders": ["o_orderkey", "o_custkey"],
    }
    folder = t.scratch("bronze")
    outcome = bronze.run_bronze(_bronze_frames(t), bronze.plan_bronze(CONNECTIONS, RELATIONSHIPS), folder, columns, at=AT)
    return read_snapshot(t.spark, outcome["part_two"]["path"]).drop("_ingestion_timestamp")


STORED = {
    "customer": ["c_custkey", "c_name", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"],
    "part": ["p_partkey", "p_name"],
    "supplier": ["s_suppkey", "s_name"],
}


@query("""
WITH one AS (SELECT r_regionkey, n_nationkey, c_custkey, r_name, n_name, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
two AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, r_regionkey, n_nationkey, c_custkey, r_name, n_name, upper(c_name) AS c_name, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_name, s_name,
 coalesce(CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END, l_returnflag) AS state, 'customer' AS _source_table, 3 AS _transform_config_id
FROM one FULL JOIN two ON o_orderkey = l_orderkey WHERE l_quantity > 10 AND upper(c_name) LIKE '%1'
""")
def silver_from_bronze(t: Tables) -> DataFrame:
    """Sources ingested per connection, the stored groups joined along their link, transformed and stored."""
    frames, plan, folder = _bronze_frames(t), bronze.plan_bronze(CONNECTIONS, RELATIONSHIPS), t.scratch("lake")
    outcome = bronze.run_bronze(frames, plan, folder, STORED, at=AT)
    links = bronze.group_links(plan, bronze.group_mappings(frames, plan, STORED))
    config = SilverConfig(
        id=3,
        filters={"conditions": [{"column_name": "l_quantity", "operator": ">", "value": 10}, {"column_id": 1, "operator": "LIKE", "value": "%1"}]},
        groups=(ColumnGroup("state", ("o_orderstatus", "l_returnflag"), {"o_orderstatus": {"O": "open"}}),),
        transformations=(Transformation(1, "uppercase"),),
        drop_unified_sources=True,
        column_ids={1: "c_name"},
    )
    sources = {name: (o["path"], 0) for name, o in outcome.items()}
    silver.run_silver(t.spark, sources, links, config, f"{folder}/silver", at=AT)
    return read_snapshot(t.spark, f"{folder}/silver").drop("_silver_timestamp", "_ingestion_timestamp")


COLUMNS = [
    unify.SourceColumn(1, "customer", "c_name", "varchar"),
    unify.SourceColumn(2, "customer", "c_nationkey", "int"),
    unify.SourceColumn(3, "customer", "c_acctbal", "double"),
    unify.SourceColumn(4, "customer", "c_mktsegment", "varchar"),
    unify.SourceColumn(5, "supplier", "s_name", "varchar"),
    unify.SourceColumn(6, "supplier", "s_nationkey", "bigint"),
    unify.SourceColumn(7, "supplier", "s_acctbal", "double"),
]
GROUPS = [
    unify.MappedGroup("name", (1, 5)),
    unify.MappedGroup("nation_key", (2, 6)),
    unify.MappedGroup("balance", (3, 7)),
]


@query("""
SELECT c_name AS name, c_nationkey::BIGINT AS nation_key, c_acctbal AS balance,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment,
       'customer' AS _source_table, 100 AS _source_table_id, 5 AS _dataset_id, 1 AS _batch_id FROM customer
UNION ALL
SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier', 200, 5, 1 FROM supplier
""")
def unified_dataset(t: Tables) -> DataFrame:
    """Unified columns, value maps, union and a stamped append, read back."""
    plan = unify.unified_columns(COLUMNS, GROUPS)
    rows = unify.unified_rows({"customer": t.customer, "supplier": t.supplier}, {"customer": 100, "supplier": 200}, plan, {4: {"MACHINERY": "M"}})
    path = t.scratch("unified")
    unify.write_unified(rows, path, dataset_id=5, batch_id=1, at=AT)
    return read_batches(t.spark, path).drop("_extraction_timestamp")


@query("""
SELECT o.o_orderkey AS id, o.o_custkey, o.o_orderstatus, coalesce(c.c_name, '') AS customer_name, l.l_orderkey IS NOT NULL AS has_lines
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey
""")
def denormalised_table(t: Tables) -> DataFrame:
    named = name_lookup(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", t.customer, "c_custkey", "c_name", "customer_name")
    return membership_flag(named, "o_orderkey", t.lineitem, "l_orderkey", "has_lines").withColumnRenamed("o_orderkey", "id")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderpriority <> '' ORDER BY o_orderkey LIMIT 100
""")
def missing_worklist(t: Tables) -> DataFrame:
    """The first orders still without lines."""
    flagged = membership_flag(t.orders, "o_orderkey", t.lineitem, "l_orderkey", "done")
    return flagged.where("NOT done AND o_orderpriority != ''").select("o_orderkey").orderBy("o_orderkey").limit(100)
