"""Mix sources to target weights with thresholds on a hash of each record's key.

A record is taken as often as its source's target holds the whole source, and once more if
its hash is at or below its source's threshold.  The thresholds come from histograms: words
summed by source and leading hash bits; then, inside the one bucket where the budget runs
out, by the next bits; then by full hash.  No record is sorted and none but the boundary
bucket's are looked at twice.  What the first threshold leaves open (less than the record it
stopped at) is filled by a second threshold over the records that are small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a record's hash, and how many of them each histogram leaves out.
HASH_DIGITS = 15
LEVELS = (48, 36, 0)

#: Fixed values of the production mix: weights in turn, the mix's size, the most repeats.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def record_hash(key: Column) -> Column:
    """60 bits of the key's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_DIGITS), 16, 10).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Key, source, size in words and hash of each record: all that mixing needs."""
    key = F.col(id_col)
    return docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), record_hash(key).alias("hash"))


def source_targets(records: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    Sources in code point order, NULL last, weigh ``weights`` in turn and share ``share`` of
    all words.  No target is above ``most`` times its source; what is cut off is reshared by
    weight among the others.  The fixed point is target = min(level * weight, cap) for one
    level, found with running sums over the sources in the order in which they reach their
    caps (one row per source).
    """
    if not 0 < share <= most or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive and the share within what sources can give")
    sums = records.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sums.withColumn("turn", turn)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") - 1) % len(weights) + 1))
    capped = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    gone = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = capped.withColumn("level", (F.col("budget") - gone) / left).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    return levels.select("source", "source_size", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _threshold(records: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """The hash up to which each source's records fit its budget: (source, upto), -1 for none.

    With ``nearest`` the record at which the budget runs out is included if that comes
    nearer to the budget.  A source whose records all fit gets the greatest hash.
    """
    state = budgets.select("source", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"), "budget")
    above = 4 * HASH_DIGITS
    for shift in LEVELS:
        inside = records.alias("r").join(
            state.alias("s"), F.expr(f"r.source <=> s.source and shiftright(r.hash, {above}) = s.prefix")
        )
        sums = inside.groupBy("r.source", F.expr(f"shiftright(r.hash, {shift})").alias("bucket")).agg(
            F.sum("r.size").alias("words"), F.first("s.before").alias("start"), F.first("s.budget").alias("budget")
        )
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("total", F.col("start") + running).where("total > budget")
        edge = F.min(F.struct("bucket", (F.col("total") - F.col("words")).alias("before"), "words", "budget"))
        state = stored(over.groupBy("source").agg(edge.alias("e")).select("source", F.col("e.bucket").alias("prefix"), "e.before", "e.words", "e.budget"), "mix-edge")
        above = shift
    upto = F.col("prefix") - 1
    if nearest:
        upto = F.when(F.col("words") < 2 * (F.col("budget") - F.col("before")), F.col("prefix")).otherwise(upto)
    edges = state.select(F.col("source").alias("s"), upto.alias("upto"), (F.col("budget") - F.col("before")).alias("open"))
    found = budgets.join(edges, F.col("source").eqNullSafe(F.col("s")), "left")
    upto = F.when(F.col("budget") <= 0, -1).otherwise(F.coalesce("upto", F.lit(16**HASH_DIGITS)))
    return found.select("source", upto.alias("upto"), F.coalesce("open", F.lit(0.0)).alias("open"))


def mix_budgets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """What decides a record's repeats: (source, source_size, target, whole, upto, small, small_upto).

    ``records`` as of ``sized``, stored, since they are read several times.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("bigint")  # nothing to weigh: taken once
    budgets = stored(targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    first = stored(_threshold(records, budgets, nearest=False), "mix-first")
    renamed = first.withColumnsRenamed({"source": "s", "open": "small"})
    rest = records.join(renamed, F.col("source").eqNullSafe(F.col("s"))).where("hash > upto and size <= small").select("source", "hash", "size")
    second = _threshold(rest, first.select("source", F.col("open").alias("budget")), nearest=True)
    second = second.select(F.col("source").alias("s2"), F.col("upto").alias("small_upto"))
    joined = budgets.drop("budget").join(renamed, F.col("source").eqNullSafe(F.col("s"))).join(second, F.col("source").eqNullSafe(F.col("s2")))
    return stored(joined.drop("s", "s2"), "mix-budgets")


def repeats(size: Column, key_hash: Column) -> Column:
    """How often a record is taken, by its source's row of ``mix_budgets``."""
    more = (key_hash <= F.col("upto")) | ((size <= F.col("small")) & (key_hash <= F.col("small_upto")))
    return F.col("whole") + more.cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words the mix takes of each record: (doc_id, size, source_size, target, taken).

    NULL and empty texts have size 0 and nothing to take; the NULL source is a source of its
    own, the last; records with one key share their hash and so their fate; an empty table
    gives an empty result.  Other columns are not carried.
    """
    records = stored(sized(docs, id_col, text_col, source_col), "mix-records")
    budgets = mix_budgets(records, source_targets(records, weights, share, most)).withColumnRenamed("source", "s")
    joined = records.join(budgets, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats(F.col("size"), F.col("hash"))).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each record of ``docs`` as often as it is taken, with all its columns."""
    records = stored(sized(docs, id_col, text_col, source_col), "mix-records")
    budgets = mix_budgets(records, source_targets(records, weights, share, most))
    budgets = budgets.select(F.col("source").alias("__fw_source"), *(c for c in budgets.columns if c not in ("source", "source_size", "target")))
    held = docs.select(F.struct(*map(F.col, docs.columns)).alias("__fw_row"), F.col(source_col).alias("__fw_own"), word_count(F.col(text_col)).alias("__fw_size"), record_hash(F.col(id_col)).alias("__fw_hash"))
    joined = held.join(budgets, F.col("__fw_own").eqNullSafe(F.col("__fw_source")))
    times = joined.select("__fw_row", repeats(F.col("__fw_size"), F.col("__fw_hash")).alias("__fw_times")).where("__fw_times > 0")
    return times.select("__fw_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "__fw_times"))).select("__fw_row.*")
