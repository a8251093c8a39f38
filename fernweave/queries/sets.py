"""Unions and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators import sets
from fernweave.queries.registry import Tables, query


@query("""
SELECT c_name AS name, c_nationkey::BIGINT AS nation, CASE c_mktsegment WHEN 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment, 'customer' AS _source_table, 1 AS _source_table_id FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier', 2 FROM supplier
""")
def aligned_union(t: Tables) -> DataFrame:
    customer = sets.UnionSource("customer", 1, t.customer, {"name": "c_name", "nation": "c_nationkey", "segment": "c_mktsegment"})
    supplier = sets.UnionSource("supplier", 2, t.supplier, {"name": "s_name", "nation": "s_nationkey"})
    output = {"name": "string", "nation": "bigint", "segment": "text"}
    return sets.aligned_union([customer, supplier], output, {("customer", "segment"): {"MACHINERY": "machines"}})


@query("""
SELECT p_partkey AS key, p_name, NULL AS s_name FROM part UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier
""")
def union_missing_columns(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("key"), "p_name")
    return sets.union_all_columns([part, t.supplier.select(F.col("s_suppkey").alias("key"), "s_name")])


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last_per_key(t: Tables) -> DataFrame:
    return sets.keep_last(t.events, ["user_id"], ["ts", "event_id"])


@query("""
SELECT doc_id, source, CASE WHEN lang = 'en' THEN '' ELSE lang END AS tag FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN lang = 'en' THEN 1 ELSE 0 END), doc_id) = 1
""")
def prefer_filled(t: Tables) -> DataFrame:
    tagged = t.documents.select("doc_id", "source", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("tag"))
    return sets.prefer_filled(tagged, ["source"], "tag", ["doc_id"])


def _pairs(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_discount") + 0.5).alias("score"), "l_orderkey", "l_extendedprice"
    )


@query("""
SELECT l_partkey AS a, l_suppkey AS b, l_discount + 0.5 AS score, l_orderkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_discount + 0.5 DESC, l_orderkey, l_extendedprice) = 1
""")
def best_unordered_pairs(t: Tables) -> DataFrame:
    return sets.best_pairs(_pairs(t.lineitem), "a", "b", "score", ["l_orderkey", "l_extendedprice"])


@query("""
WITH known AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem WHERE l_returnflag = 'A')
SELECT l_partkey AS a, l_suppkey AS b, l_discount + 0.5 AS score, l_orderkey, l_extendedprice FROM lineitem l
WHERE l_returnflag <> 'A' AND NOT EXISTS (SELECT 1 FROM known WHERE lo = least(l_partkey, l_suppkey) AND hi = greatest(l_partkey, l_suppkey))
""")
def new_pairs_only(t: Tables) -> DataFrame:
    """Pairs that do not exist yet in either direction; the known ones are stored reversed."""
    known = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return sets.exclude_pairs(_pairs(t.lineitem.where("l_returnflag != 'A'")), known, "a", "b")
