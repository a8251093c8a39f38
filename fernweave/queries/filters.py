"""Filters in every request dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.functions.dates import detect_date_formats
from fernweave.operators import joins, paging, predicates
from fernweave.queries.registry import Tables, query


def _inline(df: DataFrame, *conditions: tuple, logic: str = "AND", **kwargs) -> DataFrame:
    wanted = []
    for column, op, *values in conditions:
        cond = {"column_name": column, "operator": op}
        if op == "BETWEEN":
            cond |= {"value_min": values[0], "value_max": values[1]}
        elif values:
            cond["value"] = values[0]
        wanted.append(cond)
    return predicates.filter_rows(df, {"logic": logic, "conditions": wanted}, **kwargs)


@query("SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40.5 AND l_discount <= 0.05 AND l_returnflag <> 'N' AND l_tax > 0")
def inline_comparisons(t: Tables) -> DataFrame:
    return _inline(
        t.lineitem, ("l_quantity", ">=", "10"), ("l_quantity", "<", "40.5"), ("l_discount", "<=", 0.05), ("l_returnflag", "!=", "N"), ("l_tax", ">", 0)
    )


@query("SELECT * FROM customer WHERE c_name LIKE 'Customer#00000%5' OR c_mktsegment ILIKE 'mach%' OR c_acctbal = 1863.84")
def inline_like_or(t: Tables) -> DataFrame:
    return _inline(t.customer, ("c_name", "LIKE", "Customer#00000%5"), ("c_mktsegment", "ILIKE", "mach%"), ("c_acctbal", "=", "1863.84"), logic="OR")


@query("""
SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority NOT LIKE '1%'
""")
def inline_lists(t: Tables) -> DataFrame:
    """Lists may arrive as JSON text."""
    return _inline(
        t.orders, ("o_orderstatus", "IN", '["O", "F"]'), ("o_orderpriority", "NOT IN", ["5-LOW", "2-HIGH"]),
        ("o_totalprice", "BETWEEN", 1000, "200000"), ("o_orderpriority", "NOT LIKE", "1%"),
    )


@query("""
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') <> 'O'
""")
def inline_nulls(t: Tables) -> DataFrame:
    """NULL satisfies IS NULL, never an inequality."""
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return _inline(rows, ("status", "IS NULL"), ("status", "!=", "O"), logic="OR")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IS NOT NULL AND p_size > 30")
def inline_by_id(t: Tables) -> DataFrame:
    """A column id wins over the name; unknown columns are left out when not strict."""
    conditions = [
        {"column_id": 5, "column_name": "p_partkey", "operator": ">", "value": "30"},
        {"column_name": "p_size", "operator": "IS NOT NULL"},
        {"column_name": "no_such_column", "operator": "=", "value": "1"},
    ]
    return predicates.filter_rows(t.part.select("p_partkey", "p_size"), {"conditions": conditions}, column_ids={5: "p_size"}, strict=False)


@query("""
SELECT * FROM customer WHERE contains(lower(c_mktsegment), 'mach') AND NOT contains(lower(c_name), '9') AND starts_with(lower(c_name), 'cust') AND NOT ends_with(lower(c_name), '77')
""")
def grid_text(t: Tables) -> DataFrame:
    """Grid text tests ignore case and work on the text form of any column."""
    matched = predicates.grid_filter(
        t.customer,
        [
            {"column": "c_mktsegment", "operator": "contains", "value": "MACH"},
            {"column": "c_name", "operator": "not_contains", "value": 9},
            {"column": "c_name", "operator": "starts_with", "value": "CUST"},
        ],
    )
    ends = predicates.grid_filter(matched.select("c_custkey", "c_name"), [{"column": "c_name", "operator": "ends_with", "value": "77"}])
    return matched.join(ends.select("c_custkey"), "c_custkey", "left_anti").select(*t.customer.columns)


@query("SELECT * FROM events WHERE ts::DATE <= DATE '2024-01-10' AND ts::DATE >= DATE '2024-01-05' AND event_type IN ('click', 'view')")
def grid_dates(t: Tables) -> DataFrame:
    """Timestamps compare as dates, so an upper bound includes its whole day."""
    return predicates.grid_filter(
        t.events,
        [
            {"column": "ts", "operator": "lte", "value": "2024-01-10"},
            {"column": "ts", "operator": "gte", "value": "05/01/2024"},
            {"column": "event_type", "operator": "in", "value": ["click", "view"]},
        ],
    )


def _text_dates(t: Tables, pattern: str) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", pattern).alias("day"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'
""")
def grid_text_dates(t: Tables) -> DataFrame:
    """Dates held as text are found, parsed and compared as dates."""
    return predicates.grid_filter(_text_dates(t, "dd/MM/yyyy"), [{"column": "day", "operator": "between", "value": ["1997-03-01", "28/02/1998"]}])


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders WHERE o_orderdate::DATE NOT IN (DATE '1997-03-01', DATE '1998-02-28')
""")
def grid_iso_dates(t: Tables) -> DataFrame:
    """Membership tests are date-aware as well."""
    return predicates.grid_filter(_text_dates(t, "yyyy-MM-dd'T'HH:mm:ss"), [{"column": "day", "operator": "not_in", "value": ["1997-03-01", "28-02-1998"]}])


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day FROM orders WHERE o_orderdate::DATE <> DATE '1997-05-28' AND o_orderdate::DATE < DATE '1999-01-01'
""")
def grid_dash_dates(t: Tables) -> DataFrame:
    return predicates.grid_filter(
        _text_dates(t, "dd-MM-yyyy"),
        [{"column": "day", "operator": "neq", "value": "1997-05-28"}, {"column": "day", "operator": "lt", "value": "01-01-1999"}],
    )


_MIXED = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%d/%m/%y') END"""


def _mixed_dates(t: Tables) -> DataFrame:
    forms = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yy")
    day = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", form)) for i, form in enumerate(forms)])
    return t.orders.select("o_orderkey", day.alias("day"))


#: The day that such a text is read as; two-digit years lie in 2000 to 2099.
_MIXED_DAY = "CASE WHEN o_orderkey % 5 = 4 THEN strptime(strftime(o_orderdate, '%d/%m/20%y'), '%d/%m/%Y')::DATE ELSE o_orderdate::DATE END"


@query(f"""
SELECT o_orderkey, {_MIXED} AS day FROM orders WHERE {_MIXED_DAY} >= DATE '1997-01-01'
""")
def grid_mixed_dates(t: Tables) -> DataFrame:
    """Values of one column in several date forms all compare as dates; two-digit years lie in 2000 to 2099."""
    return predicates.grid_filter(_mixed_dates(t), [{"column": "day", "operator": "gte", "value": "1997-01-01"}])


@query(f"""
SELECT o_orderkey, {_MIXED} AS day FROM orders ORDER BY {_MIXED_DAY}, o_orderkey LIMIT 500
""")
def mixed_dates_sorted(t: Tables) -> DataFrame:
    """Sorting follows the day, whatever form it is written in."""
    rows = _mixed_dates(t)
    return paging.page(rows, [*paging.date_aware_keys(rows, "day"), F.col("o_orderkey")], 0, 500)


@query("""
SELECT unnest(['slash', 'dash', 'iso', 'stamp', 'short']) AS column_name, unnest(['dd/MM/yyyy', 'dd-MM-yyyy', 'yyyy-MM-dd', 'iso-datetime', 'dd/MM/yy']) AS format, (SELECT count(*) FROM orders) AS rows
""")
def date_formats(t: Tables) -> DataFrame:
    """The format found for each text column that holds dates."""
    patterns = {"slash": "dd/MM/yyyy", "dash": "dd-MM-yyyy", "iso": "yyyy-MM-dd", "stamp": "yyyy-MM-dd HH:mm:ss", "short": "dd/MM/yy"}
    df = t.orders.select(*[F.date_format("o_orderdate", p).alias(n) for n, p in patterns.items()], F.col("o_orderpriority").alias("other"))
    found = detect_date_formats(df, df.columns)
    entries = F.explode(F.create_map(*[F.lit(x) for pair in found.items() for x in pair])).alias("column_name", "format")
    return df.agg(F.count("*").alias("rows")).select(entries, "rows")


@query("""
SELECT * FROM part WHERE p_size <> 7 AND p_size BETWEEN 3 AND 45 AND p_name LIKE '%ring%' AND p_brand ILIKE 'brand%' AND p_type NOT IN ('SMALL')
""")
def browser_filter(t: Tables) -> DataFrame:
    conditions = [
        {"column": "p_size", "operator": "neq", "value": "7"},
        {"column": "p_size", "operator": "between", "values": [3, 45]},
        {"column": "p_name", "operator": "like", "value": "%ring%"},
        {"column": "p_brand", "operator": "ilike", "value": "brand%"},
        {"column": "p_type", "operator": "not_in", "values": ["SMALL"]},
    ]
    return predicates.filter_rows(t.part, {"conditions": conditions}, predicates.BROWSER)


@query("""
SELECT * FROM part WHERE contains(p_name, 'bolt') AND starts_with(p_brand, 'Brand') AND ends_with(p_type, 'Y') AND p_size >= 10 AND NOT p_partkey = 5
""")
def viewer_filter(t: Tables) -> DataFrame:
    """The viewer's text tests respect case."""
    conditions = [
        {"column": "p_name", "operator": "contains", "value": "bolt"},
        {"column": "p_brand", "operator": "starts_with", "value": "Brand"},
        {"column": "p_type", "operator": "ends_with", "value": "Y"},
        {"column": "p_size", "operator": "greater_than_equals", "value": 10},
        {"column": "p_partkey", "operator": "not_equals", "value": 5},
    ]
    return predicates.filter_rows(t.part, {"conditions": conditions}, predicates.VIEWER)


def _node(op: str, name: str, value: object, value_type: str) -> dict:
    return {"op": op, "children": [{"op": "column", "name": name}, {"op": "literal", "value": value, "valueType": value_type}]}


@query("""
SELECT * FROM lineitem WHERE (l_quantity < 10 OR l_quantity >= 45) AND NOT (l_returnflag = 'A') AND NOT (l_shipdate IS NULL)
 AND l_shipdate <= TIMESTAMP '2000-01-01 00:00:00' AND l_orderkey > 5
""")
def predicate_tree(t: Tables) -> DataFrame:
    tree = {
        "op": "and",
        "children": [
            {"op": "or", "children": [_node("lessThan", "l_quantity", "10", "double"), _node("greaterThanOrEqual", "l_quantity", 45, "int")]},
            {"op": "not", "children": [_node("equal", "l_returnflag", "A", "string")]},
            {"op": "not", "children": [{"op": "isNull", "children": [{"op": "column", "name": "l_shipdate"}]}]},
            _node("lessThanOrEqual", "l_shipdate", "2000-01-01 00:00:00", "timestamp"),
            _node("greaterThan", "l_orderkey", "5", "long"),
        ],
    }
    return t.lineitem.where(predicates.predicate_tree(t.lineitem, tree))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src3')")
def dict_filter(t: Tables) -> DataFrame:
    rows, _ = predicates.dict_filter(t.documents, {"lang": "en", "source": ["src1", "src3"], "unknown": 1})
    return rows.drop("text")


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def expression_filter(t: Tables) -> DataFrame:
    return predicates.expression_filter(t.orders, "o_orderstatus = 'O' AND o_totalprice > 100000")


@query("""
SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey FROM (SELECT c_custkey + 50 AS c_custkey, c_nationkey FROM customer) c
FULL JOIN supplier ON c_custkey = s_suppkey WHERE coalesce(c_nationkey, s_nationkey) = 5
""")
def ambiguous_filter(t: Tables) -> DataFrame:
    """A name two joined tables have filters on the first value present, after the join."""
    customer = t.customer.select((F.col("c_custkey") + 50).alias("c_custkey"), "c_nationkey")
    joined = joins.keyed_join(customer, t.supplier.select("s_suppkey", "s_nationkey"), [("c_custkey", "s_suppkey")], "full")
    return predicates.ambiguous_filter(joined, ["c_nationkey", "s_nationkey"], "eq", "5")


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(substring(source, 4), '^[0-9]+$') AND trim(lang) <> ''")
def present_rows(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang", F.expr("substring(source, 4)").alias("number"))
    return predicates.present_rows(predicates.present_rows(rows, "number", digits_only=True), "lang").select("doc_id", "source")


@query("SELECT * FROM part WHERE (p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_brand ILIKE '%ring%') AND p_size = 10")
def keyword_search(t: Tables) -> DataFrame:
    return predicates.keyword_search(t.part, "RING", ["p_name", "p_type", "p_brand"], {"p_size": 10})
