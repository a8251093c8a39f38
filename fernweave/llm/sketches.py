"""Bottom-k sketches of documents: the k least hashes of their word shingles.

The sketch of two parts together is the k least of both sketches, so parts can be sketched
anywhere and merged in any order.  From two sketches follow estimates of resemblance,
containment and of the number of distinct shingles; sets of at most k shingles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.stored import sent_if_few, stored

WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Words in a shingle, hashes in a sketch, bits of a hash.
SHINGLE = 5
SKETCH = 128
HASH_BITS = 48

#: Rows in one run of neighbours, and cuts that follow the spread of the keys.
RUN_ROWS = 2048
KEY_CUTS = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """A hash for each run of ``words`` words; a shorter text is one run; NULL and blank texts have none."""
    def hashed(value: Column) -> Column:
        return F.shiftrightunsigned(value, 64 - HASH_BITS)

    def runs(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: hashed(F.xxhash64(*(F.get(w, i + k) for k in range(words)))))
        short = F.array(hashed(F.xxhash64(F.array_join(w, " "))))
        return F.when(F.size(w) >= words, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    split = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
    return _let(F.transform(split, lambda w: F.xxhash64(w)), runs)


def bottom(hashes: Column, k: int = SKETCH) -> Column:
    """The k least distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, words: int = SHINGLE, k: int = SKETCH) -> Column:
    return bottom(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of common shingles among all of both; 1 if neither has any."""
    def shared(both: Column) -> Column:
        common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    return _let(merge(a, b, k), shared)


def distinct_count(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = F.lit(float(2**HASH_BITS))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) * span / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as one string, twelve hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def _run_of(key: Column, cuts: list[int], rows: int) -> Column:
    """Number of the run that a key belongs to: which cut it is behind, and how far behind in equal steps."""
    edges = F.array(*(F.lit(c).cast("bigint") for c in cuts))
    steps = -(-rows // (RUN_ROWS * len(cuts)))

    def number(behind: Column) -> Column:
        low = F.get(edges, behind - 1).cast("double")
        high = F.coalesce(F.get(edges, behind).cast("double"), F.lit(float(cuts[-1]) + 1))
        inside = F.floor((key.cast("double") - low) / (high - low) * F.lit(float(steps)))
        return (behind * F.lit(steps).cast("bigint") + F.least(inside, F.lit(steps - 1).cast("bigint"))).cast("bigint")

    return _let(F.size(F.filter(edges, lambda c: c <= key)), number)


def with_next(rows: DataFrame, key: DataFrame, key_col: str, tie_col: str, carried: list[str]) -> DataFrame:
    """Add ``next_<name>`` for the carried columns: those of the row that follows in ascending key, after the last the first.

    Rows are dealt into runs of neighbouring keys, each sorted by itself.  Cuts between runs
    follow quantiles of the keys (``key``: the same keys, cheap to read twice), each part
    being divided evenly.  A copy of each run's first row goes to the run before it, so that
    its last row finds its successor; these first rows are few and found by a broadcast, so
    that the rows are shuffled once only.  Keys are whole numbers, NULL comes first; rows of one
    key follow each other by ``tie_col``.
    """
    low = F.lit(-(2**63)).cast("bigint")
    keys = key.select(F.coalesce(F.col(key_col).cast("bigint"), low).alias("k"))
    shares = [i / KEY_CUTS for i in range(KEY_CUTS + 1)]
    count, first, quantiles = keys.agg(F.count("*"), F.min("k"), F.percentile_approx("k", shares, 10 * KEY_CUTS)).first()
    if not count:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    runs = -(-count // RUN_ROWS)
    cuts = sorted({first, *quantiles[:: max(1, KEY_CUTS // runs)]})
    numbered = keys.withColumn("run", _run_of(F.col("k"), cuts, count))
    starts = numbered.groupBy("run").agg(F.min("k").alias("start"))
    following = F.coalesce(F.lead("start").over(Window.orderBy("run")), F.lit(first).cast("bigint"))
    starts = stored(starts.select(F.col("run").alias("before"), following.alias("start")), "run-starts")
    held = rows.withColumn("__fw_key", F.coalesce(F.col(key_col).cast("bigint"), low))
    own = held.withColumns({"__fw_run": _run_of(F.col("__fw_key"), cuts, count), "__fw_copy": F.lit(False)})
    copies = held.join(sent_if_few(starts), F.col("__fw_key") == F.col("start")).withColumns({"__fw_run": F.col("before"), "__fw_copy": F.lit(True)}).drop("before", "start")
    in_run = Window.partitionBy("__fw_run").orderBy("__fw_copy", "__fw_key", tie_col)
    linked = own.unionByName(copies).withColumns({f"next_{c}": F.lead(c).over(in_run) for c in carried})
    return linked.where(~F.col("__fw_copy")).drop("__fw_run", "__fw_copy", "__fw_key")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch and estimated number of shingles of each text: (id, sketch, distinct_shingles).

    NULL and blank texts have the empty sketch.  Rows stand alone; repeated rows and NULL ids
    are returned as they come, an empty table gives an empty result, other columns are not
    carried and cannot clash.
    """
    made = docs.select(F.col(id_col), sketch(F.col(text_col)).alias("sketch"))
    return made.withColumn("distinct_shingles", distinct_count(F.col("sketch")))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch each text and its edit, whose last quarter is the beginning of the next document.

    Returns (id, n_chars, edited, sketch, edited_sketch, near_edited, near_next).  NULL texts
    count as empty.  The next document is that of the next id; among rows of one id (NULL ids
    first) texts follow each other in order, the last row is followed by the first.  An
    empty table gives an empty result; other columns are not carried.
    """
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = with_next(text.withColumn("sketch", sketch(F.col("text"))), docs.select(F.col(id_col).alias("id")), "id", "text", ["text", "sketch"])
    cut = F.expr("char_length(text) div 4").cast("int")
    kept = F.expr("char_length(text) - char_length(text) div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = linked.select("id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
