"""Joins along relationships, lookups, membership, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.config import Relationship
from fernweave.operators import joins
from fernweave.plans import sharing
from fernweave.queries.registry import Tables, query
from fernweave.queries.sinks import CHANGED_SQL, changed_customers


@query("""
SELECT c_custkey, o_orderkey, c_name, o_totalprice, l_partkey, l_quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
""")
def related_tables(t: Tables) -> DataFrame:
    """Three tables joined along their declared relationships."""
    links = [Relationship("customer", "c_custkey", "orders", "o_custkey"), Relationship("orders", "o_orderkey", "lineitem", "l_orderkey")]
    tables = {
        "customer": t.customer.select("c_custkey", "c_name"),
        "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "lineitem": t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"),
    }
    return joins.join_related(tables, links)[0]


@query("""
SELECT l_partkey, l_orderkey, l_extendedprice, p_name, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey AND p_retailprice * 10 < l_extendedprice
""")
def conditional_join(t: Tables) -> DataFrame:
    """A relationship with a condition beyond its keys."""
    link = Relationship("lineitem", "l_partkey", "part", "p_partkey", condition="part.p_retailprice * 10 < lineitem.l_extendedprice")
    tables = {"lineitem": t.lineitem.select("l_partkey", "l_orderkey", "l_extendedprice"), "part": t.part.select("p_partkey", "p_name", "p_retailprice")}
    return joins.join_related(tables, [link])[0]


_CONDITION = """
SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, o_totalprice, c_name, c_acctbal FROM orders {how} JOIN customer ON o_custkey = c_custkey AND o_totalprice > 30 * c_acctbal
"""


def _conditional(t: Tables, how: str) -> DataFrame:
    link = Relationship("orders", "o_custkey", "customer", "c_custkey", how, condition="orders.o_totalprice > 30 * customer.c_acctbal")
    tables = {"orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "customer": t.customer.select("c_custkey", "c_name", "c_acctbal")}
    return joins.join_related(tables, [link])[0]


@query(_CONDITION.format(how="LEFT").replace("coalesce(o_custkey, c_custkey)", "o_custkey"))
def conditional_left_join(t: Tables) -> DataFrame:
    """Rows whose partner fails the condition stay, without it."""
    return _conditional(t, "left")


@query(_CONDITION.format(how="FULL"))
def conditional_full_join(t: Tables) -> DataFrame:
    return _conditional(t, "full")


@query("""
WITH a AS (SELECT c_custkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT o_custkey + 5 AS k, count(*) AS orders FROM orders GROUP BY 1),
 c AS (SELECT s_suppkey * 7 AS k, count(*) AS suppliers FROM supplier GROUP BY 1), d AS (SELECT p_partkey + 11 AS k, count(*) AS parts FROM part GROUP BY 1),
 e AS (SELECT user_id * 3 AS k, count(*) AS events FROM events GROUP BY 1)
SELECT k, customers, orders, suppliers, parts, events FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) FULL JOIN d USING (k) FULL JOIN e USING (k)
""")
def chained_full_joins(t: Tables) -> DataFrame:
    """Five tables, full joins on a unified key, no cardinality declared."""
    keys = {"a": (t.customer, F.col("c_custkey"), "customers"), "b": (t.orders, F.col("o_custkey") + 5, "orders"), "c": (t.supplier, F.col("s_suppkey") * 7, "suppliers")}
    keys |= {"d": (t.part, F.col("p_partkey") + 11, "parts"), "e": (t.events, F.col("user_id") * 3, "events")}
    tables = {name: df.groupBy(key.alias("k")).agg(F.count("*").alias(n)) for name, (df, key, n) in keys.items()}
    links = [Relationship("a", "k", other, "k", "full") for other in "bcde"]
    return joins.join_related(tables, links)[0]


_FULL = """
WITH c AS (SELECT c_custkey + 100 AS c_custkey, c_name FROM customer), o AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, o_orderkey FROM c {how} JOIN o ON c_custkey = o_custkey
"""


def _gapped(t: Tables, how: str) -> DataFrame:
    tables = {
        "customer": t.customer.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name"),
        "orders": t.orders.select("o_orderkey", "o_custkey"),
    }
    return joins.join_related(tables, [Relationship("customer", "c_custkey", "orders", "o_custkey", how)])[0]


@query(_FULL.format(how="FULL"))
def unified_key_full_join(t: Tables) -> DataFrame:
    """Keys missing on either side: one key column holds whichever is there."""
    return _gapped(t, "full")


@query(_FULL.format(how="LEFT"))
def unified_key_left_join(t: Tables) -> DataFrame:
    return _gapped(t, "left")


@query(_FULL.format(how="RIGHT"))
def unified_key_right_join(t: Tables) -> DataFrame:
    return _gapped(t, "right")


@query("""
SELECT coalesce(o_custkey, c_custkey) AS o_custkey, o_orderkey, o_totalprice, coalesce(c_nationkey, n_nationkey) AS c_nationkey, c_name, n_name
FROM orders FULL JOIN customer ON o_custkey = c_custkey FULL JOIN (SELECT n_nationkey + 1 AS n_nationkey, n_name FROM nation) n ON c_nationkey = n_nationkey
""")
def link_join(t: Tables) -> DataFrame:
    """Groups joined by links; an unknown join type means full, a second path between joined groups is left out."""
    links = [
        Relationship("orders", "o_custkey", "customer", "c_custkey", "whatever", cardinality="many_to_one"),
        Relationship("customer", "c_nationkey", "nation", "n_nationkey", "full", cardinality="many_to_one"),
        Relationship("nation", "n_nationkey", "customer", "c_nationkey", "inner"),
    ]
    tables = {
        "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice"),
        "customer": t.customer.select("c_custkey", "c_name", "c_nationkey"),
        "nation": t.nation.select((F.col("n_nationkey") + 1).alias("n_nationkey"), "n_name"),
    }
    return joins.join_related(tables, links, default_how="full")[0]


@query("""
WITH c AS (SELECT c_custkey + 100 AS c_custkey, c_name FROM customer), o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1),
s AS (SELECT s_suppkey + 40 AS s_suppkey, s_name FROM supplier)
SELECT coalesce(c_custkey, o_custkey, s_suppkey) AS c_custkey, c_name, orders, s_name FROM c FULL JOIN o ON c_custkey = o_custkey FULL JOIN s ON coalesce(c_custkey, o_custkey) = s_suppkey
""")
def shared_key_full_joins(t: Tables) -> DataFrame:
    """Three sources with gaps joined in full on one key: a key is one row, wherever it occurs."""
    tables = {
        "customer": t.customer.select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name"),
        "orders": t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")),
        "supplier": t.supplier.select((F.col("s_suppkey") + 40).alias("s_suppkey"), "s_name"),
    }
    links = [
        Relationship("customer", "C_CUSTKEY", "orders", "o_custkey", "full", cardinality="one_to_one"),
        Relationship("customer", "c_custkey", "supplier", "S_suppkey", "full", cardinality="one_to_one"),
    ]
    return joins.join_related(tables, links)[0]


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name AS n_name, o.o_totalprice FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 300000 ORDER BY o.o_orderkey LIMIT 50
""")
def chained_lookups(t: Tables) -> DataFrame:
    """Select, from, joins, where, limit as one request."""
    return joins.chained_query(
        ("orders", t.orders),
        [("customer", t.customer, "o_custkey", "c_custkey"), ("nation", t.nation, "c_nationkey", "n_nationkey")],
        where="o_totalprice > 300000",
        select=["orders.o_orderkey", "customer.c_name", "nation.n_name", "o_totalprice"],
        order_by=["o_orderkey"],
        limit=50,
    )


@query("""
SELECT s.nationkey, s.name, s.s_suppkey, c.name AS name_customer, c.n FROM (SELECT s_nationkey AS nationkey, s_name AS name, s_suppkey FROM supplier) s
LEFT JOIN (SELECT c_nationkey AS nationkey, max(c_name) AS name, count(*) AS n FROM customer GROUP BY 1) c ON s.nationkey = c.nationkey
""")
def suffixed_lookup(t: Tables) -> DataFrame:
    supplier = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), "s_suppkey")
    customer = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.max("c_name").alias("name"), F.count("*").alias("n"))
    return joins.lookup_join(supplier, customer, "nationkey", suffix="_customer")


@query("""
SELECT c_custkey, coalesce(n_name, '') AS nation_name FROM customer LEFT JOIN (SELECT n_nationkey + 1 AS n_nationkey, n_name FROM nation) n ON c_nationkey = n_nationkey
""")
def name_lookup(t: Tables) -> DataFrame:
    shifted = t.nation.withColumn("n_nationkey", F.col("n_nationkey") + 1)
    out = joins.name_lookup(t.customer, "c_nationkey", shifted, "n_nationkey", "n_name", "nation_name")
    return out.select("c_custkey", "nation_name")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attach_derived(t: Tables) -> DataFrame:
    return joins.attach_by_id(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def membership_flag(t: Tables) -> DataFrame:
    return joins.membership_flag(t.documents.select("doc_id"), "doc_id", t.labels, "doc_id", "labelled")


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join(t: Tables) -> DataFrame:
    return joins.absent_rows(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


@query("SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def semi_join(t: Tables) -> DataFrame:
    return joins.present_in(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


@query(f"""
WITH {CHANGED_SQL} SELECT n.c_custkey, o.c_name AS c_name_old, n.c_name AS c_name_new, o.c_acctbal AS c_acctbal_old, n.c_acctbal AS c_acctbal_new,
 concat_ws(',', CASE WHEN n.c_name IS DISTINCT FROM o.c_name THEN 'c_name' END, CASE WHEN n.c_acctbal IS DISTINCT FROM o.c_acctbal THEN 'c_acctbal' END) AS changed_fields
FROM changed n JOIN customer o ON n.c_custkey = o.c_custkey
""")
def compare_versions(t: Tables) -> DataFrame:
    out = joins.compare_versions(t.customer, changed_customers(t.customer), "c_custkey", ["c_name", "c_acctbal"])
    return out.withColumn("changed_fields", F.concat_ws(",", "changed_fields"))


@query("""
WITH d AS (SELECT l_orderkey, l_returnflag, l_linestatus, max((l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS m FROM lineitem GROUP BY 1, 2, 3)
SELECT o.o_orderkey, o.flag, o.status, m[1] AS l_shipdate, m[2] AS l_partkey FROM (SELECT o_orderkey, 'A' AS flag, 'F' AS status FROM orders) o
LEFT JOIN d ON o.o_orderkey = d.l_orderkey AND o.flag = d.l_returnflag AND o.status = d.l_linestatus
""")
def composite_enrichment(t: Tables) -> DataFrame:
    """Details attached by three keys; the last one of a key wins."""
    orders = t.orders.select("o_orderkey", F.lit("A").alias("flag"), F.lit("F").alias("status"))
    keys = [("o_orderkey", "l_orderkey"), ("flag", "l_returnflag"), ("status", "l_linestatus")]
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    return joins.enrich_latest(orders, t.lineitem, keys, order, ["l_shipdate", "l_partkey"])


@query("""
SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey + 1
""")
def metadata_star(t: Tables) -> DataFrame:
    """Column, table, schema and connection style chain of lookups."""
    tables = {"supplier": t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "nation": t.nation, "region": t.region.withColumn("r_regionkey", F.col("r_regionkey") + 1)}
    links = [Relationship("supplier", "s_nationkey", "nation", "n_nationkey"), Relationship("nation", "n_regionkey", "region", "r_regionkey")]
    return joins.join_related(tables, links)[0].select("s_suppkey", "s_name", "n_name", "r_name")


@query("""
SELECT c_custkey AS recipient_id, o_orderkey AS share_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 2000 AND o_orderstatus <> 'P'
""")
def live_grants(t: Tables) -> DataFrame:
    """Shares (orders) every active recipient (customer) may use."""
    recipients = t.customer.select(F.col("c_custkey").alias("recipient_id"), (F.col("c_acctbal") > 2000).alias("is_active"))
    granted = t.orders.select(F.col("o_custkey").alias("recipient_id"), F.col("o_orderkey").alias("share_id"))
    shares = t.orders.select(F.col("o_orderkey").alias("share_id"), (F.col("o_orderstatus") != "P").alias("is_active"))
    return sharing.live_grants(recipients, granted, shares)
