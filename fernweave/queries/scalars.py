"""Text, template, type and page functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions import coerce, html, templates, text
from fernweave.operators.digests import BUCKETS
from fernweave.plans import sharing
from fernweave.queries.registry import Tables, query
from fernweave.queries.sinks import CHANGED_SQL, changed_customers
from fernweave.sinks.snapshots import write_snapshot

_DIGITS = "lpad(c_custkey::VARCHAR, 11, '0')"


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, trim('  ' || p_name || ' ') AS trimmed FROM part")
def letter_case(t: Tables) -> DataFrame:
    name = F.col("p_name")
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return t.part.select("p_partkey", text.lowercase(name).alias("low"), text.uppercase(name).alias("up"), text.trim(padded).alias("trimmed"))


@query("SELECT doc_id, md5(trim(regexp_replace(replace(text, ' ', '  '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS text_hash FROM documents")
def normalized_spaces(t: Tables) -> DataFrame:
    doubled = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    return t.documents.select("doc_id", F.md5(text.normalize_spaces(doubled)).alias("text_hash"))


@query("""
SELECT doc_id, md5(translate(text, 'áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC')) AS text_hash FROM documents
""")
def accents_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.remove_accents(F.col("text"))).alias("text_hash"))


@query("SELECT doc_id, md5(strip_accents(text)) AS text_hash FROM documents")
def all_accents_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.remove_all_accents(F.col("text"))).alias("text_hash"))


@query(f"""
SELECT c_custkey, regexp_replace({_DIGITS}, '^([0-9]{{3}})([0-9]{{3}})([0-9]{{3}})([0-9]{{2}})$', '\\1.\\2.\\3-\\4') AS formatted, c_name AS untouched FROM customer
""")
def template_rewrite(t: Tables) -> DataFrame:
    """Values that fit the template are formatted, others pass."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 11, "0")
    rule = "{d3}.{d3}.{d3}-{d2}"
    return t.customer.select("c_custkey", templates.rewrite(digits, rule).alias("formatted"), templates.rewrite(F.col("c_name"), rule).alias("untouched"))


@query("""
SELECT c_custkey, regexp_replace(lpad(c_custkey::VARCHAR, 8, '0'), '^([0-9]{5})([0-9]{3})$', '\\1-\\2') AS code,
 upper(substring(c_mktsegment, 1, 3)) || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS plate, NULL::VARCHAR AS misfit FROM customer
""")
def template_strict(t: Tables) -> DataFrame:
    """Pre-processed, matched whole and formatted; NULL when a value does not fit."""
    spaced = F.concat_ws(" ", F.substring("c_mktsegment", 1, 3), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    return t.customer.select(
        "c_custkey",
        templates.normalise(F.concat(F.lit("no. "), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), "{d5}-{d3}").alias("code"),
        templates.normalise(F.lower(spaced), "{L3}-{d4}").alias("plate"),
        templates.normalise(F.col("c_mktsegment"), "{d5}").alias("misfit"),
    )


@query("""
SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, regexp_replace(c_name, '[^a-zA-Z]', '', 'g') AS letters, regexp_replace(c_name, '[^a-zA-Z0-9]', '', 'g') AS alnum,
 upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS titled, upper(substring(c_name, 1, 1)) || lower(substring(c_name, 2)) AS capital, 'c' || upper(substring(c_name, 2)) AS swapped FROM customer
""")
def preprocessors(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", text.preprocess(name, "digits_only").alias("digits"), text.preprocess(name, "letters_only").alias("letters"),
        text.preprocess(name, "strip | alphanumeric").alias("alnum"), text.preprocess(segment, "lowercase|title").alias("titled"),
        text.preprocess(name, "capitalize").alias("capital"), text.preprocess(name, "swapcase").alias("swapped"),
    )


@query(f"""
SELECT c_custkey, substring({_DIGITS}, 1, 3) || '.' || substring({_DIGITS}, 4, 3) || '.' || substring({_DIGITS}, 7, 3) || '-' || substring({_DIGITS}, 10, 2) AS cpf_formatado,
 '(' || substring({_DIGITS}, 1, 2) || ') ' || substring({_DIGITS}, 3, 5) || '-' || substring({_DIGITS}, 8, 4) AS telefone_formatado, '+55' || {_DIGITS} AS telefone_e164, NULL::VARCHAR AS cep_limpo FROM customer
""")
def default_rules(t: Tables) -> DataFrame:
    digits = F.lpad(F.col("c_custkey").cast("string"), 11, "0")
    names = ("cpf_formatado", "telefone_formatado", "telefone_e164", "cep_limpo")
    return t.customer.select("c_custkey", *[templates.normalise_by_rule(digits, n).alias(n) for n in names])


@query("""
SELECT c_custkey, length(s) = 8 AS ok, s AS original, CASE WHEN length(s) = 8 THEN substring(s, 1, 5) || '-' || substring(s, 6) END AS normalised, CASE WHEN s <> '' THEN 'cep_formatado' END AS rule,
 CASE WHEN s = '' THEN 'empty value' WHEN length(s) <> 8 THEN 'value does not fit the rule' END AS error
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 8, '0') END AS s FROM customer)
""")
def rule_results(t: Tables) -> DataFrame:
    """Outcome per value: ok, original, normalised, rule and reason."""
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, "").when(key % 3 == 1, key.cast("string")).otherwise(F.lpad(key.cast("string"), 8, "0"))
    return t.customer.select("c_custkey", templates.normalise_result(value, "cep_formatado").alias("r")).select("c_custkey", "r.*")




@query(f"""
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN lang WHEN 4 THEN ' NULL' END AS tag, '' AS void FROM documents
""")
def missing_words(t: Tables) -> DataFrame:
    """Words for "missing" become NULL; a column without any value becomes empty text."""
    k = F.col("doc_id") % 5
    tag = F.when(k == 0, "NaN").when(k == 1, "None").when(k == 2, "").when(k == 3, F.col("lang")).otherwise(" NULL")
    return coerce.clean_missing(t.documents.select("doc_id", tag.alias("tag"), F.lit("nan").alias("void")), ["tag", "void"])


@query("""
SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0) AS none FROM events
""")
def numeric_coercion(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", coerce.to_number(k, "bigint").alias("k"), coerce.to_number(F.col("event_type")).alias("none"))


@query("""
SELECT doc_id, toxic = 1 AS toxic_text, quality = 0 AS word, CASE WHEN quality = 1 THEN 'maybe' ELSE 'no' END AS other FROM labels
""")
def flag_like_text(t: Tables) -> DataFrame:
    """Text columns that hold only yes/no words become booleans; the others stay."""
    rows = t.labels.select(
        "doc_id", F.col("toxic").cast("string").alias("toxic_text"), F.when(F.col("quality") == 0, " Yes").otherwise("none").alias("word"),
        F.when(F.col("quality") == 1, "maybe").otherwise("no").alias("other"),
    )
    return coerce.cast_flag_like(rows)


@query("""
SELECT c_custkey, '' AS c_name, 0 AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS c_acctbal, c_mktsegment, c_custkey % 3 = 0 AS fresh FROM customer
""")
def schema_reconcile(t: Tables) -> DataFrame:
    """New rows brought to an existing schema: coerced, defaulted, new columns kept."""
    new = t.customer.select(
        F.when(F.col("c_custkey") % 3 == 0, "yes").otherwise("no").alias("flag"), F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("c_acctbal"), "c_mktsegment",
    ).withColumn("fresh", coerce.to_flag(F.col("flag"))).drop("flag")
    return coerce.reconcile(new, t.customer.schema)


@query("""
SELECT doc_id, position::INTEGER AS position, href FROM (SELECT doc_id, generate_subscripts(h, 1) - 1 AS position, unnest(h) AS href FROM
 (SELECT page_id AS doc_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))
""")
def page_links(t: Tables) -> DataFrame:
    return html.links(t.pages.withColumnRenamed("page_id", "doc_id"), "doc_id", "html")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, o_orderpriority AS speciality, c_name AS person, '' AS code, '' AS place FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
""")
def html_table_rows(t: Tables) -> DataFrame:
    """Records from pages whose table rows are read from their first date on."""
    def cell(c: Column) -> Column:
        return F.concat(F.lit("<td class='x'>"), c, F.lit(" </td>"))

    day = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    row = F.concat(
        F.lit('<table><tr><td>01/01/2000</td></tr><tr data-ri="0" role="row">'), cell(F.lit("<b>#</b>")), cell(day),
        cell(F.concat(F.lit("<i>"), "o_orderpriority", F.lit("</i>"))), cell(F.col("c_name")), F.lit("</tr></table>"),
    )
    page = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", row.alias("page"))
    return html.table_records(page, "o_orderkey", "page", ["day", "speciality", "person", "code", "place"])


@query("SELECT c_custkey, (c_custkey % 90)::INTEGER AS total FROM customer")
def stated_totals(t: Tables) -> DataFrame:
    page = F.concat(F.lit("<p>1-10 de <b>"), F.col("c_custkey") % 90, F.lit("</b> registros</p>"))
    return t.customer.select("c_custkey", html.stated_total(page).alias("total"))


@query("""
SELECT path FROM (SELECT user_id AS path, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))
WHERE r = 1 AND action IN ('view', 'click', 'purchase')
""")
def log_replay(t: Tables) -> DataFrame:
    """Paths active at a version of an action log (users as paths, events as actions)."""
    action = F.when(F.col("event_type").isin("view", "click", "purchase"), "add").otherwise("remove")
    log = t.events.select(F.col("event_id").alias("version"), F.col("user_id").alias("path"), action.alias("action"))
    newest = log.agg(F.max("version")).first()[0]
    return sharing.replay_log(log, "path", "action", ["version"], newest // 2)


_CHANGES = f"""
WITH {CHANGED_SQL}, j AS (SELECT o.c_custkey AS ok, n.c_custkey AS nk, o.c_acctbal AS oa, n.c_acctbal AS na, o.c_name AS oname, n.c_name AS nname FROM customer o FULL JOIN changed n ON o.c_custkey = n.c_custkey)
SELECT 'insert' AS _change_type, nk AS c_custkey, nname AS c_name, na AS c_acctbal FROM j WHERE ok IS NULL
UNION ALL SELECT 'delete', ok, oname, oa FROM j WHERE nk IS NULL UNION ALL SELECT 'update_pre', ok, oname, oa FROM j WHERE oa <> na UNION ALL SELECT 'update_post', nk, nname, na FROM j WHERE oa <> na
"""


@query(_CHANGES)
def change_feed(t: Tables) -> DataFrame:
    """What happened between two stored versions, row by row."""
    path, columns = t.scratch("feed"), ["c_custkey", "c_name", "c_acctbal"]
    write_snapshot(t.customer.select(*columns), path)
    write_snapshot(changed_customers(t.customer).select(*columns), path)
    return sharing.table_changes(t.spark, path, 0, 1, "c_custkey")


@query(_CHANGES)
def change_feed_by_digest(t: Tables) -> DataFrame:
    """The same feed, joining only key buckets whose digests differ."""
    path, columns = t.scratch("feed"), ["c_custkey", "c_name", "c_acctbal"]
    write_snapshot(t.customer.select(*columns), path)
    write_snapshot(changed_customers(t.customer).select(*columns), path)
    return sharing.table_changes(t.spark, path, 0, 1, "c_custkey", buckets=BUCKETS)


@query("SELECT l_returnflag, count(*) AS n, false AS truncated FROM lineitem GROUP BY 1")
def read_only_query(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("shared_lines")
    return sharing.read_only_query(t.spark, "SELECT l_returnflag, count(*) AS n FROM shared_lines GROUP BY l_returnflag;")


@query("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 40 AND NOT l_returnflag = 'N'")
def shared_rows(t: Tables) -> DataFrame:
    """A consumer asks for the latest version but is pinned to the first."""
    path = t.scratch("shared")
    write_snapshot(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), path)
    write_snapshot(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").where("l_quantity < 3"), path)

    def node(op: str, name: str, value: str, kind: str) -> dict:
        return {"op": op, "children": [{"op": "column", "name": name}, {"op": "literal", "value": value, "valueType": kind}]}

    wanted = [node("greaterThanOrEqual", "l_quantity", "40", "double"), {"op": "not", "children": [node("equal", "l_returnflag", "N", "string")]}]
    return sharing.shared_rows(t.spark, path, {"op": "and", "children": wanted}, pinned=0)
