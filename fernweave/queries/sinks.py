"""Writing: snapshots, appends, upserts, exports, manifests, registration, logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.queries.registry import Tables, query
from fernweave.sinks import buckets, snapshots, tables
from fernweave.sources.snapshots import commits, read_snapshot

JAN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@query("""
SELECT 0 AS version, 'overwrite' AS operation, (SELECT count(*) FROM lineitem) AS rows
UNION ALL SELECT 1, 'overwrite', (SELECT count(*) FROM lineitem WHERE l_quantity > 25)
""")
def snapshot_commits(t: Tables) -> DataFrame:
    """Each overwrite leaves a commit with the rows counted while writing."""
    path = t.scratch("lineitem")
    snapshots.write_snapshot(t.lineitem, path, at=JAN)
    snapshots.write_snapshot(t.lineitem.where("l_quantity > 25"), path, at=JAN)
    return commits(t.spark, path).select(F.col("version").cast("int").alias("version"), "operation", "rows")


@query("""
SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, NULL AS o_orderpriority, 4 AS _dataset_id, 0 AS _batch_id FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, 4, 1 FROM orders WHERE o_orderstatus <> 'O'
""")
def append_batches(t: Tables) -> DataFrame:
    """Two stamped batches as text, the second with one more column."""
    path = t.scratch("append")
    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    first = t.orders.where("o_orderstatus = 'O'").select(*columns[:2])
    tables.append_batch(first, path, 4, 0, as_text=True)
    tables.append_batch(t.orders.where("o_orderstatus != 'O'").select(*columns), path, 4, 1, as_text=True)
    return tables.read_batches(t.spark, path).drop("_extraction_timestamp")


def changed_customers(customer: DataFrame) -> DataFrame:
    """The customer table some time later: rows gone, changed and added."""
    kept = customer.where("c_acctbal <= 9000").withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    )
    added = customer.where("c_acctbal < 0").withColumn("c_custkey", F.col("c_custkey") + 1000000000000)
    return kept.unionByName(added)


CHANGED_SQL = """
changed AS (
  SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
  FROM customer WHERE c_acctbal <= 9000
  UNION ALL SELECT c_custkey + 1000000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0
)"""


@query(f"""
WITH {CHANGED_SQL} SELECT * FROM changed UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changed)
""")
def upsert_by_key(t: Tables) -> DataFrame:
    path = t.scratch("upsert")
    snapshots.upsert(t.customer, path, ["c_custkey"])
    snapshots.upsert(changed_customers(t.customer), path, ["c_custkey"])
    return read_snapshot(t.spark, path)


@query(f"""
WITH {CHANGED_SQL} SELECT * FROM changed UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changed)
""")
def upsert_in_buckets(t: Tables) -> DataFrame:
    """The same upsert into a table in hash buckets, of which it rewrites those it touches."""
    path = t.scratch("upsert-buckets")
    buckets.upsert_buckets(t.customer, path, ["c_custkey"], buckets=16)
    buckets.upsert_buckets(changed_customers(t.customer), path, ["c_custkey"])
    return buckets.read_buckets(t.spark, path)


@query(f"""
WITH {CHANGED_SQL} SELECT n.c_custkey, coalesce(o.c_name, NULL) AS c_name, coalesce(o.c_nationkey, NULL) AS c_nationkey, n.c_acctbal, coalesce(o.c_mktsegment, NULL) AS c_mktsegment
 FROM changed n LEFT JOIN customer o ON n.c_custkey = o.c_custkey
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changed)
""")
def upsert_partial_columns(t: Tables) -> DataFrame:
    """A batch with two columns only: the others keep their values, new rows have none."""
    path = t.scratch("upsert-partial")
    snapshots.upsert(t.customer, path, ["c_custkey"])
    snapshots.upsert(changed_customers(t.customer).select("c_custkey", "c_acctbal"), path, ["c_custkey"])
    return read_snapshot(t.spark, path)


@query(f"""
WITH {CHANGED_SQL} SELECT 0 AS version, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 1, (SELECT count(*) FROM changed)
""")
def change_gated_write(t: Tables) -> DataFrame:
    """Written three times, stored twice: the repeat changes nothing."""
    path, fields = t.scratch("gated"), ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    for df in (t.customer, t.customer, changed_customers(t.customer)):
        snapshots.write_if_changed(df, path, "c_custkey", fields)
    return commits(t.spark, path).select(F.col("version").cast("int").alias("version"), "rows")


@query("SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'click'")
def partitioned_write(t: Tables) -> DataFrame:
    """Written by event type; the read opens one folder only."""
    path = t.scratch("events")
    tables.write_partitioned(t.events.select("event_id", "user_id", "value", "event_type"), path, ["event_type"])
    return t.spark.read.parquet(path).where("event_type = 'click'")


@query("SELECT true AS fewer_files, count(*) AS rows FROM orders")
def sized_write(t: Tables) -> DataFrame:
    """Sixteen small partitions written in fewer files."""
    path = t.scratch("sized")
    small = t.orders.repartition(16, "o_orderkey")
    done = snapshots.write_snapshot(small, path, resize=True)
    return commits(t.spark, path).select(F.lit(done.files < 16).alias("fewer_files"), "rows")


@query("SELECT * FROM orders")
def compacted_table(t: Tables) -> DataFrame:
    path = t.scratch("compact")
    snapshots.write_snapshot(t.orders, path)
    snapshots.compact(t.spark, path, ["o_custkey"], min_rows=1)
    return read_snapshot(t.spark, path)


@query("""
SELECT event_id AS version, ts AS committed_at FROM events
WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id < (SELECT max(event_id) FROM events)
""")
def expired_versions(t: Tables) -> DataFrame:
    """Of a long commit log (here the events), what is older than a week on a given day."""
    log = t.events.select(F.col("event_id").alias("version"), F.col("ts").alias("committed_at"))
    return snapshots.expired_versions(log, dt.datetime(2024, 1, 27))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def export_csv(t: Tables) -> DataFrame:
    path, rows = t.scratch("csv"), t.part.select("p_partkey", "p_name", "p_retailprice")
    tables.export(rows, path, "csv")
    return t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query("""
SELECT conv_id, to_json({'turn': turn, 'role': role})::VARCHAR AS place, md5(text) AS text_hash FROM conversations
""")
def export_ndjson(t: Tables) -> DataFrame:
    """Nested values become text; line breaks in a text survive."""
    path = t.scratch("ndjson")
    tables.export(t.conversations.select("conv_id", F.struct("turn", "role").alias("place"), "text"), path, "ndjson")
    back = t.spark.read.schema("conv_id bigint, place string, text string").json(path)
    return back.select("conv_id", "place", F.md5("text").alias("text_hash"))


@query("""SELECT 'run1' AS stamp, count(*) AS count, '{"lang": "en"}' AS filters FROM documents WHERE lang = 'en'""")
def dataset_manifest(t: Tables) -> DataFrame:
    path = t.scratch("manifest")
    tables.write_manifest(t.documents.where("lang = 'en'"), "doc_id", path, "run1", {"lang": "en"})
    return tables.read_manifest(t.spark, path)[0].drop("ids")


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en'")
def dataset_manifest_ids(t: Tables) -> DataFrame:
    path = t.scratch("manifest")
    tables.write_manifest(t.documents.where("lang = 'en'"), "doc_id", path, "run1", {"lang": "en"})
    return tables.read_manifest(t.spark, path)[1]


@query("SELECT s_suppkey, s_name FROM supplier")
def registered_table(t: Tables) -> DataFrame:
    """A stored folder registered as a table and read by name."""
    path = t.scratch("table")
    t.supplier.write.parquet(path)
    name = tables.register_location(t.spark, 12, "Supplier list", path)
    return t.spark.table(name).select("s_suppkey", "s_name")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def registered_view(t: Tables) -> DataFrame:
    name = tables.register_view(t.lineitem, 9, "Line items")
    return t.spark.sql(f"SELECT l_returnflag, count(*) AS n FROM `{name}` GROUP BY l_returnflag")


@query("""
SELECT 8 AS config_id, 0 AS version, 'partial' AS status, 1 AS n_paths, (SELECT count(*) FROM orders) AS rows_processed
UNION ALL SELECT 8, 1, 'success', 2, (SELECT count(*) FROM orders)
""")
def execution_log(t: Tables) -> DataFrame:
    """Two executions of one configuration; in the first, one group fails and the other is kept."""
    log, started = t.scratch("executions"), dt.datetime.now(dt.timezone.utc)

    def write(df: DataFrame):
        def job() -> str:
            path = t.scratch("group")
            snapshots.write_snapshot(df, path)
            return path

        return job

    n = t.orders.count()
    broken = t.orders.select(F.raise_error(F.lit("broken source")).alias("x"))
    for groups in ({"a": write(t.orders), "b": write(broken)}, {"a": write(t.orders), "b": write(t.customer)}):
        tables.log_execution(t.spark, log, 8, tables.run_groups(groups), started, n, n, {"groups": list(groups)})
    done = t.spark.read.parquet(log)
    return done.select(
        F.col("config_id").cast("int").alias("config_id"), F.col("version").cast("int").alias("version"), "status",
        F.size("paths").alias("n_paths"), "rows_processed",
    )


def _tagged(t: Tables) -> DataFrame:
    datasets = t.customer.select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("name"))
    columns = t.orders.select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("column_id"), F.col("o_orderpriority").alias("data_type"))
    sources = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return tables.tagged_metadata(datasets, columns, sources)


@query("""
SELECT 'dataset' AS record_type, c_custkey AS dataset_id, c_name AS name, NULL::BIGINT AS column_id, NULL AS data_type, NULL::BIGINT AS source_id FROM customer
UNION ALL SELECT 'column', o_custkey, NULL, o_orderkey, o_orderpriority, NULL FROM orders
UNION ALL SELECT 'source', NULL, s_name, NULL, NULL, s_suppkey FROM supplier
""")
def tagged_metadata(t: Tables) -> DataFrame:
    return _tagged(t)


@query("""
SELECT 'dataset' AS record_type, count(*) AS count FROM customer UNION ALL SELECT 'column', count(*) FROM orders UNION ALL SELECT 'source', count(*) FROM supplier
""")
def tagged_record_counts(t: Tables) -> DataFrame:
    return tables.record_counts(_tagged(t))


@query("""
SELECT true AS valid, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS row_count, 'column,dataset' AS record_types,
       '' AS errors, 'manifest missing' AS warnings
""")
def export_validation(t: Tables) -> DataFrame:
    """An export without its manifest: valid, with a warning."""
    path = t.scratch("export")
    _tagged(t).where("record_type != 'source'").write.parquet(path)
    return tables.validate_export(t.spark, path, f"{path}-manifest")
