"""Reading: snapshots, damaged files, batch files, catalogs, previews, inventories."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.queries.registry import Tables, query
from fernweave.sinks.snapshots import write_snapshot
from fernweave.sources import catalog, files
from fernweave.sources.snapshots import read_snapshot

JAN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FEB = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def snapshot_latest(t: Tables) -> DataFrame:
    path = t.scratch("orders")
    write_snapshot(t.orders, path, at=JAN)
    write_snapshot(t.orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), path, at=FEB)
    return read_snapshot(t.spark, path)


@query("SELECT * FROM customer")
def snapshot_by_version(t: Tables) -> DataFrame:
    """An old version stays readable, with its own schema, after the table was replaced."""
    path = t.scratch("customer")
    write_snapshot(t.customer, path, at=JAN)
    write_snapshot(t.customer.select("c_custkey", F.lit(1).alias("flag")), path, at=FEB)
    return read_snapshot(t.spark, path, version=0)


@query("SELECT * FROM part")
def snapshot_as_of(t: Tables) -> DataFrame:
    path = t.scratch("part")
    write_snapshot(t.part, path, at=JAN)
    write_snapshot(t.part.where("p_size > 25"), path, at=FEB)
    return read_snapshot(t.spark, path, as_of=dt.datetime(2024, 1, 15))


@query("""
SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_nationkey = 4 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_nationkey <> 3
""")
def csv_tolerant(t: Tables) -> DataFrame:
    """Lines with an open quote are closed, with too many fields rejected, with too few filled."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    row = (
        F.when(nation == 3, F.concat_ws(";", key, "c_name", "c_mktsegment", F.lit("surplus")))
        .when(nation == 4, F.concat_ws(";", key, "c_name"))
        .when(nation == 5, F.concat(F.concat_ws(";", key, "c_name", F.concat(F.lit('"'), "c_mktsegment"))))
        .otherwise(F.concat_ws(";", key, F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment"))
    )
    folder = t.scratch("csv")
    t.customer.select(row.alias("value")).write.text(folder)
    return files.read_csv_tolerant(t.spark, folder, header="c_custkey;c_name;c_mktsegment")[0]


def _mixed_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers as two kinds of files: another order of columns, another separator, quoted line breaks, surplus fields."""
    name = F.concat(F.lit('"'), F.regexp_replace("s_name", "#", "\n"), F.lit('"'))
    left = t.supplier.where("s_suppkey % 2 = 0").select(F.concat_ws(";", "s_suppkey", name).alias("line"), F.col("s_suppkey").alias("at"))
    surplus = F.when(F.col("s_suppkey") % 5 == 0, F.lit("more"))
    right = t.supplier.where("s_suppkey % 2 = 1").select(F.concat_ws(",", "s_name", "s_suppkey", surplus).alias("line"), F.col("s_suppkey").alias("at"))
    folder, parts = t.scratch("csv-mixed"), 1 + t.supplier.count() // 500
    for rows, header in ((left, "s_suppkey;s_name"), (right, "s_name,s_suppkey")):
        firsts = t.spark.range(parts).select(F.lit(header).alias("line"), F.lit(-1).cast("long").alias("at"), F.col("id").alias("part"))
        dealt = firsts.unionByName(rows.withColumn("part", F.col("at") % parts)).repartition(parts, "part").sortWithinPartitions("part", "at")
        dealt.select("line", "part").write.partitionBy("part").mode("append").text(folder)
    return files.read_csv_tolerant(t.spark, folder)


@query("""
SELECT s_suppkey::VARCHAR AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', chr(10)) ELSE s_name END AS s_name FROM supplier
WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 <> 0
""")
def csv_mixed_files(t: Tables) -> DataFrame:
    """Every file has its own header and separator; line breaks inside quotes stay in their field."""
    return _mixed_files(t)[0]


@query("SELECT s_name || ',' || s_suppkey || ',more' AS value FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 5 = 0")
def csv_rejected_lines(t: Tables) -> DataFrame:
    return _mixed_files(t)[1]


@query("SELECT conv_id, turn, role, md5(text) AS text_hash FROM conversations WHERE role <> 'assistant'")
def json_tolerant(t: Tables) -> DataFrame:
    folder, whole = t.scratch("json"), F.to_json(F.struct("conv_id", "turn", "role", "text"))
    cut = F.expr("substring(whole, 1, length(whole) - 1)")
    damaged = t.conversations.withColumn("whole", whole).select(F.when(F.col("role") == "assistant", cut).otherwise(F.col("whole")).alias("value"))
    damaged.write.text(folder)
    good, _ = files.read_json_tolerant(t.spark, folder, t.conversations.schema)
    return good.select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


@query("SELECT c_custkey, c_name FROM customer")
def run_batches(t: Tables) -> DataFrame:
    """Of two runs' files in one folder, those with the first run's stamp in their name."""
    folder = t.scratch("batches")
    rows = t.customer.select("c_custkey", "c_name")
    rows.write.json(folder)
    stamp = re.search(r"part-\d+-([0-9a-f-]{36})", t.spark.read.text(folder).inputFiles()[0]).group(1)
    rows.withColumn("c_name", F.upper("c_name")).write.mode("append").json(folder)
    return files.read_run_batches(t.spark, folder, stamp, rows.schema).drop("_batch_file")


@query("""
SELECT 'orders' AS source_table, o_orderkey AS key, o_totalprice AS price FROM orders
UNION ALL SELECT 'lineitem', l_orderkey, l_extendedprice FROM lineitem
UNION ALL (SELECT 'part', p_partkey, p_retailprice FROM part ORDER BY p_partkey LIMIT 100)
""")
def extract_tables(t: Tables) -> DataFrame:
    """Several tables in one extract, one of them limited to its first rows."""
    frames = {
        "orders": t.orders.select("o_orderkey", "o_totalprice"),
        "lineitem": t.lineitem.select("l_orderkey", "l_extendedprice"),
        "part": t.part.select("p_partkey", "p_retailprice"),
    }
    return catalog.extract(frames, ["key", "price"], {"part": 100})


@query("""
SELECT 'default' AS schema_name, 'orders' AS table_name, 'table' AS table_type, (SELECT count(*) FROM orders) AS row_count
UNION ALL SELECT 'default', 'lineitem', 'table', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'default', 'documents', 'table', (SELECT count(*) FROM documents)
UNION ALL SELECT 'default', 'events', 'table', (SELECT count(*) FROM events)
""")
def table_catalog(t: Tables) -> DataFrame:
    return catalog.table_catalog({n: getattr(t, n) for n in ("orders", "lineitem", "documents", "events")})


@query("""
SELECT 'customer' AS table_name, column_name, data_type, pos::INTEGER AS column_position, non_null FROM (
  SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name,
         unnest(['bigint', 'string', 'int', 'double', 'string']) AS data_type, unnest([1, 2, 3, 4, 5]) AS pos,
         unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) AS non_null FROM customer)
UNION ALL
SELECT 'events', column_name, data_type, pos::INTEGER, non_null FROM (
  SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name,
         unnest(['bigint', 'timestamp_ntz', 'bigint', 'string', 'double', 'string']) AS data_type, unnest([1, 2, 3, 4, 5, 6]) AS pos,
         unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS non_null FROM events)
""")
def column_catalog(t: Tables) -> DataFrame:
    """Columns of two tables with how many values each holds."""
    from fernweave.operators.aggregates import completeness

    frames = {"customer": t.customer, "events": t.events}
    filled = None
    for name, df in frames.items():
        part = completeness(df).select(F.lit(name).alias("table_name"), "column_name", F.col("non_null_count").alias("non_null"))
        filled = part if filled is None else filled.unionByName(part)
    found = catalog.column_catalog(t.spark, frames).drop("is_nullable")
    return found.join(filled, ["table_name", "column_name"])


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def table_preview(t: Tables) -> DataFrame:
    return catalog.preview(t.orders, ["o_orderkey"], 10)


@query("SELECT DISTINCT l_returnflag AS bucket, true AS has_files, true AS has_bytes FROM lineitem")
def file_inventory(t: Tables) -> DataFrame:
    """The files a table is stored in, by flag: every flag has some, and they have a size."""
    folder = t.scratch("files")
    t.lineitem.write.partitionBy("l_returnflag").parquet(folder)
    listed = files.list_files(t.spark, folder, "*.parquet")
    found = files.file_inventory(listed, F.regexp_extract("path", "l_returnflag=([A-Z])", 1).alias("bucket"))
    return found.select("bucket", (F.col("object_count") > 0).alias("has_files"), (F.col("total_bytes") > 0).alias("has_bytes"))


@query("SELECT DISTINCT o_orderstatus AS status, 'parquet' AS extension, true AS has_bytes FROM orders")
def find_files(t: Tables) -> DataFrame:
    """All files of a table by name part and extension, whatever lies beside them."""
    folder = t.scratch("files")
    t.orders.write.partitionBy("o_orderstatus").parquet(folder)
    t.orders.select("o_orderpriority").distinct().write.csv(f"{folder}/o_orderstatus=F/notes")
    found = files.find_files(files.list_files(t.spark, folder), "part-", ("parquet",))
    status = F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("status")
    return found.select(status, F.substring_index("path", ".", -1).alias("extension"), (F.col("length") > 0).alias("has_bytes")).distinct()


_CONTAINED = """
SELECT '{t}', '{c}', 'FOREIGN KEY', '{rt}', '{rc}' WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt}))
 AND (SELECT count(DISTINCT {rc}) = count(*) FROM {rt})
"""
_KEYS = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("nation", "n_nationkey"), ("customer", "c_nationkey"), ("lineitem", "l_orderkey")]
_UNIQUE = "SELECT '{t}', '{c}', 'PRIMARY KEY', NULL, NULL WHERE (SELECT count(DISTINCT {c}) = count(*) AND count({c}) = count(*) FROM {t})"
_KEYS_SQL = " UNION ALL ".join(
    [_UNIQUE.format(t=t, c=c) for t, c in _KEYS]
    + [_CONTAINED.format(t=t, c=c, rt=rt, rc=rc) for t, c in _KEYS for rt, rc in _KEYS if t != rt]
)


@query(f"""
SELECT * FROM (SELECT 'x' AS table_name, 'x' AS column_name, 'x' AS constraint_type, 'x' AS ref_table, 'x' AS ref_column WHERE false
UNION ALL {_KEYS_SQL})
""")
def key_constraints(t: Tables) -> DataFrame:
    """Primary and foreign keys the data itself supports."""
    frames = {n: getattr(t, n) for n in ("customer", "orders", "nation", "lineitem")}
    return catalog.key_constraints(frames, _KEYS)
