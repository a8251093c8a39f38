"""Counts, profiles, reports and other grouped results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.functions.arrays import explode_array
from fernweave.operators.digests import differing_rows
from fernweave.operators.joins import keyed_join
from fernweave.operators.quantiles import exact_quantile, exact_quantiles
from fernweave.operators.ranking import first_per_key


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0 of an empty whole."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def total_count(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _value_order(column: str, order: str) -> list[Column]:
    orders = {
        "value_asc": [F.col(column).asc_nulls_last()],
        "frequency_desc": [F.col("frequency").desc(), F.col(column).asc_nulls_last()],
        "frequency_asc": [F.col("frequency").asc(), F.col(column).asc_nulls_last()],
    }
    if order not in orders:
        raise ValueError(f"unknown order {order!r}")
    return orders[order]


def distinct_values(
    df: DataFrame, column: str, search: str | None = None, order: str = "value_asc", offset: int = 0, limit: int | None = None
) -> DataFrame:
    """A column's distinct values, NULL among them, with how often each occurs: one page, or all without a limit."""
    if search:
        df = df.where(F.lower(F.col(column).cast("string")).contains(search.lower()))
    counted = df.groupBy(column).agg(F.count("*").alias("frequency"))
    page = counted.orderBy(*_value_order(column, order)).offset(offset)
    return page if limit is None else page.limit(limit)


def approximate_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.approx_count_distinct(column).alias("total_distinct"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Values by how often they occur; the ``k`` most frequent, or all."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counted if k is None else counted.orderBy(F.col("count").desc(), F.col(column).asc()).limit(k)


def group_totals(df: DataFrame, group: str, flag: Column, min_size: int = 1, digits: int = 1) -> DataFrame:
    """Rows, flagged rows and their share per non-null group of at least ``min_size`` rows."""
    totals = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    return totals.where(F.col("total") >= min_size).withColumn("percentage", percent(F.col("flagged"), F.col("total"), digits))


def category_table(df: DataFrame, column: str, key: str, min_size: int = 5, examples: int = 5) -> DataFrame:
    """Frequent values with count, share of all rows and the first few keys as JSON."""
    rows = df.where(F.col(column).isNotNull())
    counted = rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).where(F.col("count") >= min_size)
    picked = first_per_key(rows.select(F.col(column).alias("_value"), key), ["_value"], [F.col(key)], examples)
    listed = picked.groupBy("_value").agg(F.to_json(F.array_sort(F.collect_list(key))).alias("examples"))
    total = df.agg(F.count("*")).scalar()
    joined = keyed_join(counted, listed, [("name", "_value")], "inner").drop("_value")
    return joined.withColumn("occurrence_percentage", percent(F.col("count"), total))


def _long(row: DataFrame, columns: list[str], measures: dict[str, str]) -> DataFrame:
    """One aggregate row with ``{column}#{measure}`` fields as one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}#{m}`").cast(t).alias(m) for m, t in measures.items()])
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")


def completeness(df: DataFrame) -> DataFrame:
    """Filled values per column and their share, in one pass."""
    counts = [F.count(F.col(f"`{c}`")).alias(f"{c}#non_null_count") for c in df.columns]
    totals = [F.count("*").alias(f"{c}#total") for c in df.columns]
    out = _long(df.agg(*counts, *totals), df.columns, {"non_null_count": "bigint", "total": "bigint"})
    return out.select("column_name", "non_null_count", percent(F.col("non_null_count"), F.col("total")).alias("completeness_pct"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def duplicate_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys repeat and how many rows are surplus."""
    return duplicate_keys(df, keys).agg(
        F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_count")
    )


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _comparable(df: DataFrame, column: str) -> Column:
    """The column in a form that can be grouped; maps as JSON."""
    return F.to_json(column) if isinstance(df.schema[column].dataType, T.MapType) else F.col(column)


PROFILE = {
    "data_type": "string", "non_null_count": "bigint", "non_null_percentage": "double", "unique_count": "bigint",
    "sample_values": "string", "min": "double", "max": "double", "mean": "double", "median": "double",
}


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, samples: int = 5) -> DataFrame:
    """Per column: type, filled count and share, distinct count, samples; for numbers min, max, mean, median.

    All columns share one aggregate for their totals, one count of (column, value) pairs for
    distinct values and samples, and the passes of their medians, so the number of jobs does
    not follow the number of columns.  ``approximate`` sketches everything in a single pass
    and leaves samples out.
    """
    columns = columns or df.columns
    numeric = [c for c in columns if _numeric(df, c)]
    medians = {} if approximate else exact_quantiles(df, numeric)
    aggregates = []
    for c in columns:
        number = F.col(f"`{c}`").cast("double") if _numeric(df, c) else F.lit(None).cast("double")
        aggregates += [
            F.lit(df.schema[c].dataType.simpleString()).alias(f"{c}#data_type"),
            F.count(f"`{c}`").alias(f"{c}#non_null_count"),
            percent(F.count(f"`{c}`"), F.count("*")).alias(f"{c}#non_null_percentage"),
            (F.approx_count_distinct(_comparable(df, c)) if approximate else F.lit(0)).alias(f"{c}#unique_count"),
            F.lit(None).alias(f"{c}#sample_values"),
            F.min(number).alias(f"{c}#min"),
            F.max(number).alias(f"{c}#max"),
            F.avg(number).alias(f"{c}#mean"),
            (F.percentile_approx(number, 0.5) if approximate else F.lit(medians.get(c)).cast("double")).alias(f"{c}#median"),
        ]
    totals = _long(df.agg(*aggregates), columns, PROFILE)
    if approximate:
        return totals
    entries = F.array(*[F.struct(F.lit(c).alias("_column"), _comparable(df, c).cast("string").alias("_value")) for c in columns])
    counted = df.select(F.explode(entries).alias("_e")).select("_e.*").where("_value IS NOT NULL").distinct()
    distinct = counted.groupBy("_column").agg(F.count("*").alias("_n"))
    least = first_per_key(counted, ["_column"], [F.col("_value")], samples)
    shown = least.groupBy("_column").agg(F.to_json(F.array_sort(F.collect_list("_value"))).alias("_shown"))
    known = totals.join(distinct, F.col("column_name") == F.col("_column"), "left").drop("_column")
    known = known.join(shown, F.col("column_name") == F.col("_column"), "left")
    known = known.withColumns({"unique_count": F.coalesce("_n", F.lit(0)), "sample_values": F.coalesce("_shown", F.lit("[]"))})
    return known.select("column_name", *PROFILE)


def number_statistics(df: DataFrame, column: str) -> DataFrame:
    """Count, range, mean, median and standard deviation of a number column."""
    x = F.col(column).cast("double")
    return df.agg(
        F.count(column).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg(x).alias("avg"), F.stddev_samp(x).alias("stddev"),
    ).withColumn("median", F.lit(exact_quantile(df, column)).cast("double"))


def text_statistics(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent texts, with the number of distinct texts beside them."""
    distinct = df.agg(F.count_distinct(column)).scalar()
    return value_counts(df, column, k).withColumn("distinct_count", distinct)


def date_statistics(df: DataFrame, column: str) -> DataFrame:
    """Rows per year and month with the first and last date of the month."""
    d = F.to_date(column)
    return df.where(F.col(column).isNotNull()).groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(
        F.count("*").alias("count"), F.min(d).alias("first_date"), F.max(d).alias("last_date")
    )


def dashboard(df: DataFrame, name: str, flag: Column, measure: Column, top: int = 5) -> DataFrame:
    """Totals, flagged rows, measure sum and share done, then the names with the largest measure."""
    totals = df.agg(
        F.count("*").alias("total_count"), F.count_if(flag).alias("flagged_count"),
        F.coalesce(F.sum(measure), F.lit(0)).alias("measure_total"),
    )
    numbers = totals.select(
        F.explode(
            F.create_map(
                F.lit("total_count"), F.col("total_count").cast("double"),
                F.lit("flagged_count"), F.col("flagged_count").cast("double"),
                F.lit("measure_total"), F.round(F.col("measure_total").cast("double"), 2),
                F.lit("done_percentage"), percent(F.col("flagged_count"), F.col("total_count")),
            )
        ).alias("name", "value")
    ).select(F.lit("totals").alias("section"), "name", "value")
    best = (
        df.groupBy(F.col(name).cast("string").alias("name"))
        .agg(F.round(F.sum(measure).cast("double"), 2).alias("value"))
        .orderBy(F.col("value").desc(), F.col("name"))
        .limit(top)
        .select(F.lit("top").alias("section"), "name", "value")
    )
    return numbers.unionByName(best)


def merge_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Distinct (key, field, value) rows: every value the records of a key hold."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = df.select(key, F.explode(entries).alias("_e")).select(key, "_e.field", "_e.value")
    return long.where("value IS NOT NULL").distinct()


def merge_records(df: DataFrame, key: str, fields: list[str], list_fields: list[str] = (), part_size: int = 1000) -> DataFrame:
    """One record per key; a field with several values becomes a sorted JSON list.

    Values are made distinct per key before they meet.  A field with more than about
    ``part_size`` values of one key is dealt over several rows of that key, numbered by
    ``part``, so every value is there and no list outgrows a task.  Part 0 always exists and
    holds all fields that need no other.
    """
    values = merge_values(df, key, fields)
    sized = values.groupBy(F.col(key).alias("_key"), F.col("field").alias("_field")).agg(F.count("*").alias("_n"))
    counted = keyed_join(values, sized, [(key, "_key"), ("field", "_field")], right_unique=True).drop("_key", "_field")
    part = F.pmod(F.xxhash64("value"), F.ceil(F.col("_n") / F.lit(part_size))).cast("int")
    lists = counted.withColumn("part", part).groupBy(key, "field", "part").agg(F.array_sort(F.collect_list("value")).alias("items"), F.first("_n").alias("_n"))
    as_list = F.col("field").isin(*list_fields) if list_fields else F.lit(False)
    text = F.when((F.col("_n") == 1) & ~as_list, F.col("items")[0]).otherwise(F.to_json("items"))
    found = lists.groupBy(key, "part").pivot("field", fields).agg(F.first(text))
    ids = df.select(F.col(key).alias("_id"), F.lit(0).alias("_part")).distinct()
    first = keyed_join(ids, found.where("part = 0"), [("_id", key)], "left", right_unique=True)
    first = first.select(F.col("_id").alias(key), F.col("_part").alias("part"), *fields)
    return first.unionByName(found.where("part > 0"))


def count_multi_valued(df: DataFrame, column: str, skip_blank: bool = True) -> DataFrame:
    """How often each value occurs in a column that holds single values or JSON lists.

    Text that only looks like a list counts as itself.  Where the lists would be merged from
    rows first, count those with :func:`count_merged`.
    """
    parsed = F.when(F.col(column).startswith("["), F.from_json(column, "array<string>"))
    values = explode_array(df, [], F.coalesce(parsed, F.array(F.col(column))), "value")
    if skip_blank:
        values = values.where("trim(value) != ''")
    return values.groupBy("value").agg(F.count("*").alias("count"))


def count_merged(df: DataFrame, key: str, column: str) -> DataFrame:
    """How many keys hold each value of a field, without building their lists."""
    values = merge_values(df, key, [column]).where("trim(value) != ''")
    return values.groupBy("value").agg(F.count("*").alias("count"))


def distinct_per_column(df: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct values per column with the prefix, all in one aggregate."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    row = df.agg(*[F.count_distinct(F.col(c)).alias(f"{c}#unique_count") for c in columns])
    return _long(row, columns, {"unique_count": "bigint"})


def child_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Each parent with its number of children per kind, 0 when there are none.

    Children are counted before they meet the parents, so several kinds do not multiply.
    """
    out = parents
    for name, (child, child_key) in children.items():
        counted = child.groupBy(F.col(child_key).alias(f"_{name}_key")).agg(F.count("*").alias(f"_{name}"))
        out = keyed_join(out, counted, [(key, f"_{name}_key")], "left", right_unique=True)
        out = out.withColumn(name, F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}", f"_{name}_key")
    return out


def mapping_coverage(columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """Columns, mapped columns and share, for all (``data_type`` NULL) and per data type.

    ``columns``: column_id, data_type; ``mappings``: column_id.  A column in several
    groups counts once.
    """
    mapped = mappings.select(F.col("column_id").alias("_mapped")).distinct()
    joined = keyed_join(columns.select("column_id", "data_type"), mapped, [("column_id", "_mapped")], "left", right_unique=True)
    by_type = joined.groupBy("data_type").agg(F.count("*").alias("total_columns"), F.count("_mapped").alias("mapped_columns"))
    overall = by_type.agg(
        F.lit(None).cast("string").alias("data_type"),
        F.coalesce(F.sum("total_columns"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum("mapped_columns"), F.lit(0)).alias("mapped_columns"),
    )
    share = percent(F.col("mapped_columns"), F.col("total_columns"))
    return overall.unionByName(by_type).withColumn("coverage_percentage", share)


def rate_check(
    log: DataFrame, who: str, at: str, window_seconds: int, limit: int, operation: str | None = None, prefix: str = ""
) -> DataFrame:
    """Per requester and second: requests in the trailing window, and whether they reach the limit.

    Requests are first counted per second, then each second also joins the next
    window-long bucket, so one task sees at most two windows of one requester, however
    many requests that one makes.
    """
    if operation:
        log = log.where(F.col(operation).startswith(prefix))
    second = F.unix_seconds(F.col(at).cast("timestamp")).alias("second")
    per_second = log.groupBy(who, second).agg(F.count("*").alias("requests"))
    bucket = F.floor(F.col("second") / window_seconds)
    copies = F.array(
        F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))
    )
    spread = per_second.withColumn("_copy", F.explode(copies)).select(who, "second", "requests", "_copy.*")
    trailing = Window.partitionBy(who, "bucket").orderBy("second").rangeBetween(-window_seconds, 0)
    counted = spread.withColumn("in_window", F.sum("requests").over(trailing)).where("own")
    return counted.select(who, "second", "requests", "in_window", (F.col("in_window") >= limit).alias("exceeded"))


def extraction_metrics(df: DataFrame, ok: str, group: str | None = None) -> DataFrame:
    """Processed, successful and failed values with the error rate in percent."""
    failed = F.count_if(~F.coalesce(F.col(ok), F.lit(False)))
    grouped = df.groupBy(group) if group else df.groupBy()
    out = grouped.agg(F.count("*").alias("processed"), F.count_if(F.col(ok)).alias("success"), failed.alias("failed"))
    return out.withColumn("error_rate", percent(F.col("failed"), F.col("processed")))


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The number each key's next version gets, counting from 0."""
    return df.groupBy(key).agg(F.coalesce(F.max(version) + 1, F.lit(0)).alias("next_version"))


def latest_per_key(df: DataFrame, key: str, sequence: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's latest row (a running maximum, no sort per key)."""
    latest = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*sequence)).alias("_l"))
    return latest.select(key, *[F.col(f"_l.{c}").alias(c) for c in columns])


def latest_success(
    owners: DataFrame, owner_key: str, runs: DataFrame, run_key: str, ok: Column, sequence: list[str], columns: list[str]
) -> DataFrame:
    """Every owner with its latest successful run, NULL when it has none."""
    latest = latest_per_key(runs.where(ok), run_key, sequence, columns).withColumnRenamed(run_key, "_run_key")
    return keyed_join(owners, latest, [(owner_key, "_run_key")], "left", right_unique=True).drop("_run_key")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], unchanged: bool = False, buckets: int | None = None) -> DataFrame:
    """What changed between two snapshots: key, change (new, changed, removed) and the changed fields.

    With ``buckets``, only rows of key buckets whose digests differ are joined; worth it where
    few rows change.  Not for ``unchanged`` rows, which would have to be joined all the same.
    """
    if buckets and not unchanged:
        old, new = differing_rows(old, new, key, fields, buckets)
    before = old.select(F.col(key).alias("_old"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    after = new.select(F.col(key).alias("_new"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = after.join(before, F.col("_new") == F.col("_old"), "full")
    fields_changed = F.array_compact(
        F.array(*[F.when(~F.col(f"_new_{f}").eqNullSafe(F.col(f"_old_{f}")), F.lit(f)) for f in fields])
    )
    change = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed")
        .when(F.size(fields_changed) > 0, "changed").otherwise("same")
    )
    out = joined.select(
        F.coalesce("_new", "_old").alias(key), change.alias("change"),
        F.when(change == "changed", F.concat_ws(",", fields_changed)).alias("changed_fields"),
    )
    return out if unchanged else out.where("change != 'same'")
