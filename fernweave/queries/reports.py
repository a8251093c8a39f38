"""Counts, profiles, quality reports, diffs, rate checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators import aggregates as agg
from fernweave.operators import sketches
from fernweave.operators.digests import BUCKETS
from fernweave.queries.registry import Tables, query
from fernweave.queries.sinks import CHANGED_SQL, changed_customers


@query("SELECT p_type, count(*) AS frequency FROM part WHERE p_type ILIKE '%a%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def distinct_by_frequency(t: Tables) -> DataFrame:
    return agg.distinct_values(t.part, "p_type", search="A", order="frequency_desc")


@query("SELECT p_name, count(*) AS frequency FROM part GROUP BY 1 ORDER BY 1 OFFSET 5 LIMIT 10")
def distinct_page(t: Tables) -> DataFrame:
    return agg.distinct_values(t.part, "p_name", offset=5, limit=10)


@query("SELECT nullif(source, 'src1') AS source, count(*) AS frequency FROM documents GROUP BY 1 ORDER BY 2, 1 NULLS LAST LIMIT 19")
def distinct_rarest(t: Tables) -> DataFrame:
    sources = t.documents.select(F.nullif("source", F.lit("src1")).alias("source"))
    return agg.distinct_values(sources, "source", order="frequency_asc", limit=19)


@query("SELECT count(DISTINCT o_custkey) AS exact_distinct, true AS within_error FROM orders")
def approximate_distinct(t: Tables) -> DataFrame:
    """The sketch's answer is within three times its stated error (5%) of the exact one."""
    exact = t.orders.agg(F.count_distinct("o_custkey").alias("exact_distinct"))
    both = exact.withColumn("sketched", agg.approximate_distinct(t.orders, "o_custkey").scalar())
    return both.select("exact_distinct", (F.abs(F.col("sketched") - F.col("exact_distinct")) <= 0.15 * F.col("exact_distinct")).alias("within_error"))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_values(t: Tables) -> DataFrame:
    return agg.value_counts(t.orders, "o_orderpriority", 3)


@query("SELECT user_id, count(*) AS count FROM events GROUP BY 1")
def value_distribution(t: Tables) -> DataFrame:
    return agg.value_counts(t.events, "user_id")


@query("""
SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS flagged, round(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*), 1)::DOUBLE AS percentage
FROM lineitem GROUP BY 1 HAVING count(*) >= 5
""")
def group_totals(t: Tables) -> DataFrame:
    return agg.group_totals(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R", min_size=5)


@query("""
SELECT source AS name, count(*) AS count, '[' || array_to_string(list_sort(list(doc_id ORDER BY doc_id)[1:5]), ',') || ']' AS examples,
       round(count(*) * 100.0 / (SELECT count(*) FROM documents), 2)::DOUBLE AS occurrence_percentage FROM documents GROUP BY 1 HAVING count(*) >= 5
""")
def category_table(t: Tables) -> DataFrame:
    return agg.category_table(t.documents, "source", "doc_id")


@query("""
WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS column_name, unnest([count(doc_id), count(lang), count(quality), count(toxic)]) AS non_null_count,
 unnest([round(count(doc_id) * 100.0 / count(*), 2)::DOUBLE, round(count(lang) * 100.0 / count(*), 2)::DOUBLE, round(count(quality) * 100.0 / count(*), 2)::DOUBLE, round(count(toxic) * 100.0 / count(*), 2)::DOUBLE]) AS completeness_pct FROM j
""")
def completeness(t: Tables) -> DataFrame:
    return agg.completeness(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return agg.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
""")
def duplicate_total(t: Tables) -> DataFrame:
    return agg.duplicate_total(t.lineitem, ["l_orderkey", "l_linenumber"])


_PROFILE = """
SELECT '{c}' AS column_name, '{type}' AS data_type, count({c}) AS non_null_count, round(count({c}) * 100.0 / count(*), 2)::DOUBLE AS non_null_percentage,
 count(DISTINCT {c}) AS unique_count, (SELECT to_json(list(v ORDER BY v))::VARCHAR FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {table} ORDER BY 1 LIMIT 5)) AS sample_values,
 {numbers} FROM {table}
"""
_NUMBERS = "min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}::DECIMAL(18,4)), 6)::DOUBLE AS mean, median({c})::DOUBLE AS median"
_NO_NUMBERS = "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median"


@query(
    " UNION ALL ".join(
        _PROFILE.format(c=c, type=k, table="part", numbers=(_NO_NUMBERS if k == "string" else _NUMBERS.format(c=c)))
        for c, k in (("p_partkey", "bigint"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))
    )
)
def column_profile(t: Tables) -> DataFrame:
    out = agg.column_profile(t.part, ["p_partkey", "p_type", "p_size", "p_retailprice"])
    return out.withColumn("mean", F.round("mean", 6))


_ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "is_open": "int", "is_late": "bigint",
}


@query(
    """WITH flagged AS (SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate), CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open, o_orderkey % 2 AS is_late FROM orders) """
    + " UNION ALL ".join(
        _PROFILE.format(c=c, type=k, table="flagged", numbers=(_NUMBERS.format(c=c) if k in ("bigint", "int", "double") else _NO_NUMBERS)) for c, k in _ORDERS.items()
    )
)
def column_profile_all(t: Tables) -> DataFrame:
    """Every column of a table, two flags among them, one of them split evenly."""
    flagged = t.orders.withColumns({"is_open": F.when(F.col("o_orderstatus") == "O", 1).otherwise(0), "is_late": F.col("o_orderkey") % 2})
    return agg.column_profile(flagged, list(_ORDERS)).withColumn("mean", F.round("mean", 6))


_SKETCHED = """
SELECT '{c}' AS column_name, '{type}' AS data_type, count({c}) AS non_null_count, round(count({c}) * 100.0 / count(*), 2)::DOUBLE AS non_null_percentage,
 min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}::DECIMAL(18,4)), 6)::DOUBLE AS mean, true AS distinct_within_error, true AS median_within_error FROM orders
"""


@query(" UNION ALL ".join(_SKETCHED.format(c=c, type=k) for c, k in (("o_custkey", "bigint"), ("o_totalprice", "double"))))
def column_profile_approximate(t: Tables) -> DataFrame:
    """A profile in one pass; its sketched values lie within their stated errors of the exact ones."""
    columns = ["o_custkey", "o_totalprice"]
    made = agg.column_profile(t.orders, columns, approximate=True)
    exact = agg.column_profile(t.orders, columns).select(F.col("column_name").alias("c"), F.col("unique_count").alias("u"), F.col("median").alias("m"))
    both = made.join(exact, F.col("column_name") == F.col("c"))
    near = {
        "distinct_within_error": F.abs(F.col("unique_count") - F.col("u")) <= 0.15 * F.col("u"),
        "median_within_error": F.abs(F.col("median") - F.col("m")) <= 0.01 * (F.col("max") - F.col("min")),
        "mean": F.round("mean", 6),
    }
    return both.withColumns(near).select("column_name", "data_type", "non_null_count", "non_null_percentage", "min", "max", "mean", "distinct_within_error", "median_within_error")


@query("""
SELECT count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice::DECIMAL(18,2)), 4)::DOUBLE AS avg,
 round(stddev_samp(l_extendedprice), 4) AS stddev, median(l_extendedprice) AS median FROM lineitem
""")
def number_statistics(t: Tables) -> DataFrame:
    out = agg.number_statistics(t.lineitem, "l_extendedprice")
    return out.withColumns({"avg": F.round("avg", 4), "stddev": F.round("stddev", 4)})


@query("""
SELECT p_name, count(*) AS count, (SELECT count(DISTINCT p_name) FROM part) AS distinct_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def text_statistics(t: Tables) -> DataFrame:
    return agg.text_statistics(t.part, "p_name")


@query("""
SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS count, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date FROM orders GROUP BY 1, 2
""")
def date_statistics(t: Tables) -> DataFrame:
    return agg.date_statistics(t.orders, "o_orderdate")


@query("""
WITH s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS m FROM orders)
SELECT 'totals' AS section, unnest(['total_count', 'flagged_count', 'measure_total', 'done_percentage']) AS name, unnest([n, f, round(m, 2), round(100.0 * f / n, 2)]) AS value FROM s
UNION ALL (SELECT 'top', o_custkey::VARCHAR, sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders GROUP BY o_custkey ORDER BY 3 DESC, 2 LIMIT 5)
""")
def dashboard(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return agg.dashboard(t.orders, "o_custkey", F.col("o_orderstatus") == "F", price)


_MERGED = """
SELECT user_id, 0 AS part, CASE WHEN count(DISTINCT event_type) = 0 THEN NULL ELSE to_json(list_sort(list(DISTINCT event_type)))::VARCHAR END AS event_type,
 CASE WHEN count(DISTINCT k) = 1 THEN max(k) ELSE to_json(list_sort(list(DISTINCT k)))::VARCHAR END AS k
FROM (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY user_id
"""


def _merged(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return agg.merge_records(rows, "user_id", ["event_type", "k"], ["event_type"])


@query(_MERGED)
def merged_records(t: Tables) -> DataFrame:
    """One record per user; a field with several values becomes a JSON list."""
    return _merged(t)


@query("""
SELECT user_id, 'k' AS field, k AS value FROM (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events)
QUALIFY count(*) OVER (PARTITION BY user_id) > 20
""")
def merged_overflow(t: Tables) -> DataFrame:
    """The values of fields that are dealt over several rows, read back from them."""
    rows = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    merged = agg.merge_records(rows, "user_id", ["event_type", "k"], ["event_type"], part_size=20)
    items = F.coalesce(F.from_json("k", "array<string>"), F.array("k"))
    values = merged.where("k IS NOT NULL").select("user_id", F.lit("k").alias("field"), F.explode(items).alias("value"))
    several = values.groupBy(F.col("user_id").alias("u")).count().where("count > 20")
    return values.join(several, F.col("user_id") == F.col("u")).select("user_id", "field", "value")


@query("""
SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS n_values FROM events GROUP BY 1
""")
def merged_parts(t: Tables) -> DataFrame:
    """Values of one field per user, counted over all parts: none is lost by dealing them out."""
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").alias("k"))
    merged = agg.merge_records(rows, "user_id", ["k"], ["k"], part_size=3)
    sizes = F.coalesce(F.size(F.from_json("k", "array<string>")), F.lit(0))
    return merged.groupBy("user_id").agg(F.sum(F.greatest(sizes, F.lit(0))).alias("n_values"))


@query("""
WITH e AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS value FROM events) SELECT value, count(*) AS count FROM e GROUP BY 1
""")
def multi_valued_counts(t: Tables) -> DataFrame:
    """How many users hold each value."""
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return agg.count_merged(rows, "user_id", "k")


@query("""
WITH e AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS value FROM events) SELECT value, count(*) AS count FROM e GROUP BY 1
""")
def multi_valued_list_counts(t: Tables) -> DataFrame:
    """The same from the merged records' lists, over all their parts."""
    return agg.count_multi_valued(_merged(t), "k")


@query("""
SELECT unnest(['l_shipdate', 'l_suppkey']) AS column_name, unnest([count(DISTINCT l_shipdate), count(DISTINCT l_suppkey)]) AS unique_count FROM lineitem
""")
def distinct_per_prefix(t: Tables) -> DataFrame:
    return agg.distinct_per_column(t.lineitem, "l_s")


@query("""
SELECT p_partkey, p_name, coalesce(n, 0)::BIGINT AS returned FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) x ON p_partkey = l_partkey
""")
def child_counts(t: Tables) -> DataFrame:
    """Parts with their number of returned large lines, 0 for most."""
    returned = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45")
    return agg.child_counts(t.part.select("p_partkey", "p_name"), "p_partkey", {"returned": (returned, "l_partkey")})


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished,
 (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000) AS big FROM customer
""")
def several_child_counts(t: Tables) -> DataFrame:
    children = {
        "finished": (t.orders.where("o_orderstatus = 'F'"), "o_custkey"),
        "big": (t.orders.where("o_orderstatus = 'P' AND o_totalprice > 300000"), "o_custkey"),
    }
    return agg.child_counts(t.customer.select("c_custkey"), "c_custkey", children)


def _rate_sql(seconds: int, limit: int) -> str:
    return f"""
WITH s AS (SELECT user_id, epoch(ts)::DECIMAL(20,6) AS e FROM events WHERE starts_with(event_type, 'c')),
p AS (SELECT user_id, floor(e)::BIGINT AS second, count(*) AS requests FROM s GROUP BY 1, 2)
SELECT user_id, second, requests, w::BIGINT AS in_window, w >= {limit} AS exceeded FROM (
 SELECT *, sum(requests) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW) AS w FROM p)
"""


@query(_rate_sql(3600, 2))
def hourly_rate(t: Tables) -> DataFrame:
    """Requests in the hour up to each request, against a limit."""
    return agg.rate_check(t.events, "user_id", "ts", 3600, 2, "event_type", "c")


@query(_rate_sql(86400, 4))
def daily_rate(t: Tables) -> DataFrame:
    return agg.rate_check(t.events, "user_id", "ts", 86400, 4, "event_type", "c")


@query("""
SELECT lang, count(*) AS processed, count(*) FILTER (n_chars > 500) AS success, count(*) FILTER (NOT n_chars > 500) AS failed,
 round(count(*) FILTER (NOT n_chars > 500) * 100.0 / count(*), 2)::DOUBLE AS error_rate FROM documents GROUP BY 1
""")
def extraction_metrics(t: Tables) -> DataFrame:
    return agg.extraction_metrics(t.documents.withColumn("ok", F.col("n_chars") > 500), "ok", "lang")


@query("SELECT user_id, max(event_id) + 1 AS next_version FROM events GROUP BY 1")
def next_version(t: Tables) -> DataFrame:
    return agg.next_version(t.events, "user_id", "event_id")


@query("""
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(t: Tables) -> DataFrame:
    return agg.latest_per_key(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F'
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey
""")
def latest_success(t: Tables) -> DataFrame:
    """Every customer with its latest finished order, also those without one."""
    return agg.latest_success(
        t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", F.col("o_orderstatus") == "F",
        ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"],
    )


_DIFFERENCES = f"""
WITH {CHANGED_SQL} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey,
 CASE WHEN o.c_custkey IS NULL THEN 'new' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN 'c_acctbal' END AS changed_fields
FROM changed n FULL JOIN customer o ON n.c_custkey = o.c_custkey
WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR n.c_acctbal <> o.c_acctbal
"""


@query(_DIFFERENCES)
def snapshot_diff(t: Tables) -> DataFrame:
    return agg.snapshot_diff(t.customer, changed_customers(t.customer), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query(_DIFFERENCES)
def snapshot_diff_by_digest(t: Tables) -> DataFrame:
    """The same differences, joining only key buckets whose digests differ."""
    return agg.snapshot_diff(t.customer, changed_customers(t.customer), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], buckets=BUCKETS)


@query("SELECT l_returnflag, l_quantity AS value, count(*) AS count, 0 AS may_be_off_by FROM lineitem GROUP BY 1, 2")
def merged_frequent_values(t: Tables) -> DataFrame:
    """Quantities by how often they occur, from summaries stored for each month; few values, so counts are exact."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    path = t.scratch("summaries")
    sketches.summarise_values(t.lineitem.select("l_returnflag", "l_quantity", month), "l_quantity", ["l_returnflag", "month"]).write.parquet(path)
    merged = sketches.merge_summaries(t.spark.read.parquet(path), ["l_returnflag"])
    return sketches.frequent_values(merged, 100, ["l_returnflag"])


@query("SELECT o_orderstatus, count(o_custkey) AS n_values, count(DISTINCT o_custkey) AS exact_distinct, true AS within_error FROM orders GROUP BY 1")
def merged_distinct_counts(t: Tables) -> DataFrame:
    """Distinct customers by status from summaries stored for each month, within three standard errors of the exact count."""
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    path = t.scratch("summaries")
    sketches.summarise_values(t.orders.select("o_orderstatus", "o_custkey", month), "o_custkey", ["o_orderstatus", "month"]).write.parquet(path)
    merged = sketches.distinct_estimates(sketches.merge_summaries(t.spark.read.parquet(path), ["o_orderstatus"]), ["o_orderstatus"])
    exact = t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("exact_distinct"))
    near = F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= 3 * 1.04 / 2 ** (sketches.REGISTERS / 2) * F.col("exact_distinct")
    return merged.join(exact, "o_orderstatus").select("o_orderstatus", "n_values", "exact_distinct", near.alias("within_error"))
