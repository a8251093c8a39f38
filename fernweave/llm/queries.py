"""The queries of this package, each a thin use of its operator over a whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bpe, divergence, hard_negatives, language, mixing, near_dedup, quality, secret_scan, sharding, simhash, sketches, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL twin if it has one."""
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def codec(path: str = RANK_FILE) -> bpe.Codec:
    return bpe.Codec.from_file(path)


@lru_cache
def counter(path: str = TOKENIZER_FILE) -> token_counts.TokenCounter:
    return token_counts.TokenCounter.from_file(path)


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the ids and the decoded bytes are given as digests."""
    coded = bpe.round_trip(table(spark, sf_dir), bpe.share(spark, codec()))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than 512 tokens."""
    return token_counts.count_tokens(table(spark, sf_dir), bpe.share(spark, counter()))


@query("""
WITH r AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM r GROUP BY source
), w AS (
    SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
    FROM s
), l AS (
    SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w
), t AS (
    SELECT source, source_size,
        CASE WHEN level * weight <= cap THEN max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight ELSE cap END AS target
    FROM l
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS whole FROM t
), c AS (
    SELECT *, target - whole * source_size AS budget FROM b
), g AS (
    SELECT r.source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY r.source ORDER BY h) AS total FROM r GROUP BY r.source, h
), e1 AS (
    SELECT c.source, arg_min(g.h, g.h) - 1 AS upto, arg_min(budget - (total - words), g.h) AS small
    FROM c JOIN g ON g.source IS NOT DISTINCT FROM c.source WHERE total > budget GROUP BY c.source
), f AS (
    SELECT c.*, CASE WHEN budget <= 0 THEN -1 ELSE coalesce(upto, 1::BIGINT << 60) END AS upto, coalesce(small, 0) AS small
    FROM c LEFT JOIN e1 ON e1.source IS NOT DISTINCT FROM c.source
), g2 AS (
    SELECT r.source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY r.source ORDER BY h) AS total
    FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source WHERE h > upto AND size <= small GROUP BY r.source, h
), e2 AS (
    SELECT f.source, arg_min(CASE WHEN words < 2 * (small - (total - words)) THEN h ELSE h - 1 END, h) AS upto2
    FROM f JOIN g2 ON g2.source IS NOT DISTINCT FROM f.source WHERE total > small GROUP BY f.source
), k AS (
    SELECT f.*, CASE WHEN small <= 0 THEN -1 ELSE coalesce(upto2, 1::BIGINT << 60) END AS upto2
    FROM f LEFT JOIN e2 ON e2.source IS NOT DISTINCT FROM f.source
)
SELECT r.doc_id, r.size, k.source_size, k.target,
    (r.size * (whole + CASE WHEN h <= upto OR (size <= small AND h <= upto2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN k ON k.source IS NOT DISTINCT FROM r.source
""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the production mix takes of every document."""
    return mixing.mix(table(spark, sf_dir))


#: Shards of the production layout, all alike.
SHARDS = 24


@query("""
WITH bits AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
    SELECT doc_id, coalesce(text, '') AS text, md5(doc_id::VARCHAR) AS digest FROM documents
), crc AS (
    SELECT doc_id, digest, coalesce(strlen(text), 0) + 8 AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
    FROM d, bits
), draws AS (
    SELECT doc_id, j, -ln((('0x' || substr(md5(doc_id::VARCHAR || '#' || j::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS cost
    FROM d, range(0, 25) s(j)
), best AS (
    SELECT doc_id, arg_min(j, cost) FILTER (j < 24) AS shard, arg_min(j, cost) AS grown_shard FROM draws GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    (row_number() OVER (PARTITION BY shard ORDER BY substr(digest, 1, 3), doc_id, text_crc32, size) - 1)::BIGINT AS slot,
    grown_shard::INTEGER AS grown_shard
FROM crc JOIN best USING (doc_id)
""")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place in it of every document, and its shard once there is one more."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign_shards(docs, [1.0] * SHARDS, grown_col="grown_shard")
    numbered = sharding.number_rows(placed, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text and of its edit, and their likeness."""
    made = sketches.compare_edited(table(spark, sf_dir))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def _near() -> dict[str, str]:
    """SQL over neighbouring lines: a closed one ahead or behind with wrapped lines between, and three links in a row."""
    ahead = behind = "false"
    for k in range(4, 0, -1):
        ahead = f"(coalesce(lead(goes_on, {k - 1}) OVER o, false) AND (NOT coalesce(lead(open, {k}) OVER o, true) OR {ahead}))"
        behind = f"(coalesce(lag(goes_on, {k}) OVER o, false) AND (NOT coalesce(lag(open, {k}) OVER o, true) OR {behind}))"
    rows = [" AND ".join(f"coalesce(lead(link, {k}) OVER o, false)" if k >= 0 else f"coalesce(lag(link, {-k}) OVER o, false)" for k in range(first, first + 3)) for first in (-2, -1, 0)]
    return {"ahead": ahead, "behind": behind, "menu": "(" + " OR ".join(rows) + ")"}


_NEAR = _near()


@query("""
WITH p AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), w AS (
    SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS win FROM p, unnest(range(1, len(words) - 6)) t(i)
), r AS (
    SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM w) WHERE c > 1
), cov AS (
    SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid
), l AS (
    SELECT rid, ln, line, len(words) AS n, words, lower(line) AS low, length(rtrim(line, ' ')) AS len, length(words[1]) AS first,
        len(regexp_extract_all(line, '[#$%&*!?|<>=~^+_]{2,}')) AS marks,
        len(regexp_extract_all(' ' || line || ' ', '[ \t][|»•·][ \t]')) AS bars,
        len(list_filter(string_split_regex(line, '[ \t]'), lambda w: regexp_full_match(w, '[|»•·>/›→\\\\]'))) AS trail,
        len(list_filter(string_split_regex(line, '[ \t]'), lambda w: regexp_full_match(w, '[#$%&*!?|~^_@]+'))) AS alone,
        NOT regexp_matches(line, '[.!?…:;。！？：；।؟۔]["''”’»›)\\]}」』]*([ \t\r]|$)') AS open
    FROM (SELECT rid, ln, lines[ln] AS line, regexp_extract_all(lines[ln], '[^\x20\x09-\x0D]+') AS words FROM (SELECT rid, string_split(text, chr(10)) AS lines FROM p), unnest(range(1, len(lines) + 1)) t(ln))
), g AS (
    SELECT *, coalesce(lead(ln) OVER o = ln + 1 AND len + 1 + lead(first) OVER o > greatest(len, lead(len) OVER o) AND greatest(len, lead(len) OVER o) <= 120, false) AS goes_on, open AND n <= 3 AS link
    FROM l WHERE n > 0 WINDOW o AS (PARTITION BY rid ORDER BY ln)
), h AS (
    SELECT *, """ + _NEAR["ahead"] + " OR " + _NEAR["behind"] + """ AS carried, """ + _NEAR["menu"] + """ AS menu
    FROM g WINDOW o AS (PARTITION BY rid ORDER BY ln)
), j AS (
    SELECT *, (marks >= 2 AND marks * 4 >= n) OR (bars >= 2 AND bars * 5 >= n)
        OR (n >= 5 AND 5 * len(list_filter(range(2, n + 1), lambda k: words[k] = words[k - 1])) >= 2 * n)
        OR (open AND (n >= 8 AND NOT carried OR trail >= 2 AND trail * 5 >= n OR alone >= 2 AND alone * 4 >= n)) OR (link AND menu)
        OR """ + " OR ".join(f"contains(low, '{phrase}')" for phrase in quality.BOILERPLATE) + """ AS fails
    FROM h
), s AS (
    SELECT rid, sum(n) AS n_words, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dup FROM j GROUP BY rid
), m AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
    FROM p LEFT JOIN s USING (rid) LEFT JOIN cov USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept
FROM m
""")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules, words lost with failing lines, and the verdict on every document."""
    return quality.clean(table(spark, sf_dir)).drop("clean_text")


@query("""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), l AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles
    FROM w
), n AS (
    SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM l
), s AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM l
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), k AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)
), e AS (
    SELECT a, b FROM k UNION ALL SELECT b, a FROM k
), r AS (
    SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other
), c AS (
    SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near duplicates of every document, on shingles of four words."""
    return near_dedup.near_duplicates(table(spark, sf_dir), words=4)


#: Folds of ids held out of each fit: (folds, the one held out).
TOXIC_FOLD = (5, 0)
LANGUAGE_FOLD = (4, 2)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.NoisyOr:
    """Fitted on the labels of ids outside the held-out fold."""
    return toxicity.fit(docs, labels.where(~toxicity.in_fold(F.col("doc_id"), *TOXIC_FOLD)))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, with its offending sentences."""
    docs = table(spark, sf_dir)
    model = bpe.share(spark, toxicity_model(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.in_fold(F.col("doc_id"), *TOXIC_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    docs = table(spark, sf_dir)
    model = bpe.share(spark, language.fit(docs.where(~toxicity.in_fold(F.col("doc_id"), *LANGUAGE_FOLD))))
    made = language.predict_languages(docs, model)
    return made.select("doc_id", toxicity.in_fold(F.col("doc_id"), *LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score", "languages")


def _joined(spans: str, base_only: bool) -> Column:
    """Spans as kind:start:end, by commas."""
    listed = F.filter(spans, lambda s: s["kind"] != "model") if base_only else F.col(spans)
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, by rule and in all."""
    docs = table(spark, sf_dir)
    found = secret_scan.scan_documents(docs, bpe.share(spark, secret_scan.fit(docs)))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in secret_scan.RULES]
    return found.select("doc_id", *counts, F.sha2(_joined("spans", True).cast("binary"), 256).alias("base_sha256"), _joined("spans", False).alias("spans"))


@query("""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every text and the group of those within four bits."""
    found = simhash.near_duplicates(table(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


@query("""
WITH d AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), o AS (
    SELECT rid, lang, source, term, count(*)::BIGINT AS n FROM (SELECT rid, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS (
    SELECT lang, term FROM o GROUP BY ALL HAVING count(*) >= 30
), vs AS (
    SELECT lang, count(*) AS v FROM k GROUP BY ALL
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL
), f AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
    SELECT lang, source, term, n, (1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT)::BIGINT AS p FROM f JOIN vs USING (lang)
), u AS (
    SELECT lang, term, sum(n)::HUGEINT AS n FROM f GROUP BY ALL
), q AS (
    SELECT lang, term, (1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT)::BIGINT AS q FROM u JOIN vs USING (lang)
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
""")
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and the terms it has more of."""
    return divergence.audit(table(spark, sf_dir))
