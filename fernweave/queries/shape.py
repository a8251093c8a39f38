"""Columns: selection, names, stamps, flattening, identity, assets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions.coerce import serialise
from fernweave.functions.paths import location_parts, media_type, safe_name_column
from fernweave.operators import joins, shape
from fernweave.queries.registry import Tables, query
from fernweave.sources import files

AT = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_columns(t: Tables) -> DataFrame:
    return shape.select_columns(t.customer, ["c_mktsegment", "c_custkey", "c_name"])


@query("""
SELECT o_orderkey, to_json({'status': o_orderstatus, 'priority': o_orderpriority})::VARCHAR AS state, o_orderdate FROM orders
""")
def lake_safe_cast(t: Tables) -> DataFrame:
    """Nested values become JSON text, zoned timestamps plain ones."""
    state = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state")
    return shape.lake_safe(t.orders.select("o_orderkey", state, F.col("o_orderdate").cast("timestamp").alias("o_orderdate")))


@query("""
SELECT vec_id, '[' || array_to_string([floor(x::DOUBLE * 1000)::BIGINT FOR x IN embedding], ',') || ']' AS embedding FROM embeddings
""")
def serialise_nested(t: Tables) -> DataFrame:
    scaled = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("embedding"))
    return scaled.select("vec_id", serialise(F.col("embedding"), scaled.schema["embedding"].dataType).alias("embedding"))


@query("""
SELECT coalesce(c.nationkey, s.nationkey) AS nationkey, c.id AS customer_id, c.name AS customer_name, s.id AS supplier_id, s.name AS supplier_name
FROM (SELECT c_nationkey AS nationkey, count(*) AS id, max(c_name) AS name FROM customer GROUP BY 1) c
JOIN (SELECT s_nationkey AS nationkey, count(*) AS id, max(s_name) AS name FROM supplier GROUP BY 1) s ON c.nationkey = s.nationkey
""")
def collision_prefix(t: Tables) -> DataFrame:
    """Two tables that share column names: the key is unified, the rest get their table in front."""
    customer = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("id"), F.max("c_name").alias("name"))
    supplier = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("id"), F.max("s_name").alias("name"))
    link = joins.Relationship("customer", "nationkey", "supplier", "nationkey")
    return joins.join_related({"customer": customer, "supplier": supplier}, [link])[0]


@query("""
SELECT o_orderkey AS "early_Key", o_orderstatus AS early_status, 'orders' AS _source_table, o_orderkey AS late_key, o_totalprice AS late_STATUS FROM orders
""")
def collision_rename(t: Tables) -> DataFrame:
    """Names that differ only in case clash and get their table; the first frame keeps its provenance."""
    first = t.orders.select(F.col("o_orderkey").alias("Key"), F.col("o_orderstatus").alias("status"), F.lit("orders").alias("_source_table"))
    second = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("STATUS"), F.lit("late").alias("_source_table"))
    (a, b), names = shape.rename_clashes([("early", first), ("late", second)])
    return joins.keyed_join(a, b, [(names[0, "Key"], names[1, "key"])])


@query("SELECT n_nationkey, c_custkey, 'customer' AS _source_table FROM customer JOIN nation ON c_nationkey = n_nationkey")
def source_stamp(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "c_custkey")
    return shape.stamp_source(joined, "customer", AT).drop("_ingestion_timestamp")


@query("SELECT p_partkey, 21 AS _transform_config_id FROM part")
def silver_stamp(t: Tables) -> DataFrame:
    return shape.stamp_silver(t.part.select("p_partkey"), 21, AT).drop("_silver_timestamp")


@query("""
SELECT page_id, url, CASE WHEN trim(url) <> '' THEN 's3://lake/assets/' || regexp_extract(url, '([^/]*)$', 1) END AS _url_bronze_path FROM pages
""")
def asset_paths(t: Tables) -> DataFrame:
    return shape.add_asset_paths(t.pages.select("page_id", "url"), ["url"], "s3://lake/assets")


@query("""
WITH u AS (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN url END AS url, url AS mirror FROM pages)
SELECT page_id, url, mirror, coalesce('a/' || regexp_extract(url, '([^/]*)$', 1), 'a/' || regexp_extract(mirror, '([^/]*)$', 1)) AS _image_bronze_path FROM u
""")
def unified_asset_path(t: Tables) -> DataFrame:
    urls = t.pages.select("page_id", F.when(F.col("url").startswith("https:"), F.col("url")).alias("url"), F.col("url").alias("mirror"))
    return shape.unify_asset_paths(shape.add_asset_paths(urls, ["url", "mirror"], "a"), "image", ["url", "mirror"], drop=True)


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def drop_duplicate_columns(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return shape.drop_duplicate_columns(orders.join(customer, orders["o_custkey"] == customer["o_custkey"]))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem
""")
def drop_by_prefix(t: Tables) -> DataFrame:
    return shape.drop_by_prefix(t.lineitem, "l_ship")


@query("""
SELECT o_orderkey AS id, o_orderstatus AS state_status, o_orderpriority AS state_detail_priority, o_totalprice AS state_detail_price FROM orders
""")
def flatten_nested(t: Tables) -> DataFrame:
    detail = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")).alias("detail")
    state = F.struct(F.col("o_orderstatus").alias("status"), detail).alias("state")
    return shape.flatten(t.orders.select(F.col("o_orderkey").alias("id"), state))


@query("""
SELECT event_id, k AS field, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)
""")
def flatten_json(t: Tables) -> DataFrame:
    """JSON objects with keys nobody declared, as rows."""
    return shape.flatten_json_long(t.events, "event_id", "props")


@query("""
SELECT event_id, 'event_kind' AS field, event_type AS value FROM events UNION ALL SELECT event_id, 'event_user', user_id::VARCHAR FROM events
UNION ALL SELECT event_id, 'props_k', json_extract_string(props, '$.k') FROM events
""")
def flatten_categories(t: Tables) -> DataFrame:
    nested = F.to_json(
        F.struct(
            F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user")).alias("event"),
            F.from_json("props", "map<string,string>").alias("props"),
        )
    )
    return shape.flatten_json_long(t.events.select("event_id", nested.alias("record")), "event_id", "record", categories=True)


@query("""
SELECT page_id, url AS image_url, length(html)::BIGINT AS image_size, '' AS thumbnail_url, 0::BIGINT AS thumbnail_size FROM pages
""")
def pick_from_json(t: Tables) -> DataFrame:
    """Named values of a nested record, with defaults for what is absent."""
    full = F.struct(F.col("url"), F.length("html").alias("size")).alias("full")
    record = t.pages.select("page_id", F.to_json(F.struct(F.struct(full).alias("files"))).alias("record"))
    picks = {
        "image_url": ("$.files.full.url", "string", ""),
        "image_size": ("$.files.full.size", "bigint", 0),
        "thumbnail_url": ("$.files.thumbnail_256.url", "string", ""),
        "thumbnail_size": ("$.files.thumbnail_256.size", "bigint", 0),
    }
    return record.select("page_id", *shape.pick_json(F.col("record"), picks))


@query("""
SELECT c_custkey AS id, c_name AS full_name, c_nationkey, c_acctbal AS money, c_mktsegment, 'x' AS full_name_base64 FROM customer
""")
def rename_mapped(t: Tables) -> DataFrame:
    mapping = {"customer.c_custkey": "id", "c_custkey": "wrong", "c_acctbal": "money", "customer.c_name": "full_name"}
    return shape.rename_mapped(t.customer.withColumn("c_name_base64", F.lit("x")), "customer", mapping)


@query("SELECT s_name AS name, NULL::DOUBLE AS discount, s_suppkey AS id FROM supplier")
def align_columns(t: Tables) -> DataFrame:
    renamed = t.supplier.withColumnsRenamed({"s_name": "name", "s_suppkey": "id"})
    return shape.align(renamed, {"name": "string", "discount": "double", "id": "bigint"})


@query("""
SELECT 3 AS _dataset_id, 40 AS _source_table_id, 'customer' AS _source_table_name, 'file' AS _source_connection_type,
       c_custkey AS key, try_cast(regexp_extract(c_name, '[0-9]+') AS INTEGER) AS number, NULL::INTEGER AS c_mktsegment,
       (c_custkey % 2 = 0) AS even FROM customer
""")
def stamp_rows(t: Tables) -> DataFrame:
    """Values that do not fit their declared type become NULL."""
    rows = t.customer.select(
        F.col("c_custkey").alias("key"), F.regexp_extract("c_name", "[0-9]+", 0).alias("number"), "c_mktsegment",
        (F.col("c_custkey") % 2 == 0).alias("even"),
    )
    types = {"key": "bigint", "number": "int", "c_mktsegment": "int", "even": "boolean"}
    return shape.stamp_rows(rows, 3, 40, "customer", "file", types, AT).drop("_extraction_timestamp")


@query("""
SELECT strftime(o_orderdate, '%d/%m/%Y') AS date, o_orderpriority AS speciality, c_name AS person FROM orders JOIN customer ON o_custkey = c_custkey
""")
def header_synonyms(t: Tables) -> DataFrame:
    """A sheet's headers matched to fields by the words they contain."""
    sheet = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date "), F.col("o_orderpriority").alias("Speciality name"),
        F.col("c_name").alias("Attending person"), F.col("o_orderkey").alias("Due date"),
    )
    return shape.map_headers(sheet, {"date": ["date"], "speciality": ["special"], "person": ["person", "doctor"]}, exact=["date"])


@query("""
SELECT o_orderkey, sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || coalesce(nullif(o_orderpriority, '5-LOW'), '')) AS record_id FROM orders
""")
def row_identity(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return shape.row_identity(orders, ["o_orderkey", "o_orderstatus", "priority"]).select("o_orderkey", "record_id")


@query("""
SELECT o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS raw_json FROM orders
""")
def row_as_json(t: Tables) -> DataFrame:
    out = shape.row_identity(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], with_json=True)
    return out.select("o_orderkey", "raw_json")


@query("SELECT o_orderkey, substring(md5(o_orderstatus || '|' || o_orderpriority), 1, 8) AS query_hash FROM orders")
def query_hash(t: Tables) -> DataFrame:
    return shape.query_hash(t.orders, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "query_hash")


@query("SELECT lang, count(*) AS documents, 'application/octet-stream' AS path_type, true AS whole FROM documents GROUP BY lang")
def attach_files(t: Tables) -> DataFrame:
    """Stored files joined to the rows that name them, content as base64, which decodes to what was stored."""
    folder = t.scratch("files")
    t.documents.select("lang", F.concat(F.col("doc_id"), F.lit("#")).alias("text")).write.partitionBy("lang").text(folder)
    stored = files.read_binary(t.spark, folder)
    named = files.list_files(t.spark, folder, "part-*").select("path", "length")
    out = shape.attach_files(named, "path", stored)
    content = F.unbase64("path_base64")
    parts = out.select(
        F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "path_type",
        F.regexp_count(content.cast("string"), F.lit("#")).alias("n"), (F.octet_length(content) == F.col("length")).alias("same"),
    )
    return parts.groupBy("lang").agg(F.sum("n").cast("bigint").alias("documents"), F.max("path_type").alias("path_type"), F.bool_and("same").alias("whole"))


_KEY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/?(.*)$', 1)"


@query(f"""
SELECT DISTINCT url AS source, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)', 1) AS bucket, {_KEY} AS key,
       's3://lake/copies/' || regexp_extract({_KEY}, '([^/]*)$', 1) AS destination
FROM pages WHERE {_KEY} <> ''
""")
def asset_copy_plan(t: Tables) -> DataFrame:
    return shape.asset_copy_plan(t.pages, "url", "s3://lake/copies")


@query(f"""
SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'https' END AS scheme, regexp_extract(url, '://([^/]+)', 1) AS bucket, nullif({_KEY}, '') AS key FROM pages
""")
def storage_location(t: Tables) -> DataFrame:
    """Locations with a scheme and, where it is cut off, without one."""
    location = F.regexp_replace("url", "^http://", "")
    return t.pages.select("page_id", *[c.alias(n) for n, c in location_parts(location).items()])


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff' ELSE 'application/octet-stream' END AS media_type FROM part
""")
def media_types(t: Tables) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".tif", "")]), F.col("p_size") % 4 + 1)
    return t.part.select("p_partkey", media_type(F.concat(F.lit("a.b/"), "p_name", extension)).alias("media_type"))


@query("""
WITH n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(translate(text, 'áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC'), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9-]+', '_', 'g'), '_-')) AS name FROM documents)
SELECT doc_id, CASE WHEN name = '' THEN 'unnamed' WHEN length(name) > 255 THEN rtrim(substring(name, 1, 246), '_-') || '_' || substring(sha256(name), 1, 8) ELSE name END AS name FROM n
""")
def safe_names(t: Tables) -> DataFrame:
    """Whole texts as path parts; long ones end in a digest that keeps them apart."""
    return t.documents.select("doc_id", safe_name_column(F.col("text")).alias("name"))
