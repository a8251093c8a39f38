"""Reading files that may be damaged, file listings and batch files of one run."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.session import stored

SEPARATORS = (",", ";", "\t", "|")
CORRUPT = "_corrupt_record"

#: First lines of a file by which its separator is chosen.
SAMPLED = 20

# File extensions that count as images.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp")


def vote_separator(lines: list[str]) -> str:
    """The separator that splits most of the lines at hand into the same number of fields; :func:`_separators` for files."""
    def score(sep: str) -> tuple[int, int]:
        counts = [line.count(sep) for line in lines if line]
        same, common = max(((counts.count(n), n) for n in counts), default=(0, 0))
        return (same if common else 0, common)

    return max(SEPARATORS, key=score)


def _fields(line: Column, sep: str) -> Column:
    """Number of fields of a record; separators inside quotes do not count."""
    plain = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _separators(lines: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """(file, sep): for each file the separator that splits most of its first lines into the same number of fields."""
    order = Window.partitionBy("file").orderBy("start", "place")
    first = lines.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sampled)
    choices = F.array(*(F.struct(F.lit(s).alias("sep"), (_fields(F.col("value"), s) - 1).alias("n"), F.lit(-i).alias("rank")) for i, s in enumerate(SEPARATORS)))
    counted = first.select("file", F.explode(choices).alias("c")).select("file", "c.*").groupBy("file", "sep", "rank", "n").agg(F.count("*").alias("same"))
    common = counted.groupBy("file", "sep", "rank").agg(F.max(F.struct("same", "n")).alias("m"))
    score = F.struct(F.when(F.col("m.n") > 0, F.col("m.same")).otherwise(0).alias("same"), "m.n", "rank")
    return common.groupBy("file").agg(F.max_by("sep", score).alias("sep"))


def _odd_lines(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with an odd number of quotes: (file, start, place, opens, closes).

    ``opens`` is the number of separators before a last quote that begins a field, ``closes``
    that after a first quote that ends one; NULL where the quote does not.
    """
    line, s = F.col("value"), re.escape(sep)
    inner = '[^"]*+(?:""[^"]*+)*+'
    before = F.regexp_replace(F.regexp_replace(line, f'"{inner}"(?=({s}|$))', ""), '"[^"]*+$', "")
    after = F.regexp_replace(F.regexp_replace(line, f'^{inner}"', ""), f'"{inner}"', "")
    count = lambda text: F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))
    opens = F.when(F.rlike(line, F.lit(f'(^|{s}) *"{inner}$')), count(before))
    closes = F.when(F.rlike(line, F.lit(f'^{inner}" *({s}|$)')), count(after))
    return lines.where(_quotes(line) % 2 == 1).select("file", "start", "place", opens.alias("opens"), closes.alias("closes"))


def _windows() -> tuple[Window, Window, Window]:
    """Lines of a block, blocks of a file (one row each), and the blocks before one."""
    files = Window.partitionBy("file").orderBy("start")
    return Window.partitionBy("file", "start").orderBy("place"), files, files.rowsBetween(Window.unboundedPreceding, -1)


def _turns(odd: DataFrame, width: int) -> DataFrame:
    """Where records that a quoted line break has cut begin and end: (file, start, place, turn), turn 1 or -1.

    An odd line opens such a record if the next odd line of its file closes a field and both
    together have no more fields than the file's records; of several such lines in a row every
    other one opens.  Blocks are looked at on their own; of the blocks before and behind they
    need one row each.
    """
    block, files, past = _windows()
    blocks = odd.groupBy("file", "start").agg(F.min_by(F.struct("closes"), "place").alias("f"), F.count("*").alias("n"))
    blocks = blocks.select("file", "start", F.lead("f").over(files).alias("next"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("base"))
    closing = F.coalesce(F.lead(F.struct("closes")).over(block), F.col("next"))["closes"]
    paired = odd.join(blocks, ["file", "start"]).select(
        "file", "start", "place", (F.col("base") + F.row_number().over(block)).alias("number"), F.coalesce(F.col("opens") + closing < width, F.lit(False)).alias("pair")
    )
    lone = F.max(F.when(~F.col("pair"), F.col("number")))
    carried = paired.groupBy("file", "start").agg(lone.alias("m")).select("file", "start", F.coalesce(F.max("m").over(past), F.lit(0)).alias("past"))
    last = F.greatest(F.coalesce(lone.over(block), F.lit(0)), F.col("past"))
    opening = paired.join(carried, ["file", "start"]).withColumn("last", last).where(F.col("pair") & ((F.col("number") - F.col("last")) % 2 == 1))
    closed = paired.join(opening.select("file", (F.col("number") + 1).alias("number")), ["file", "number"])
    return opening.select("file", "start", "place", F.lit(1).alias("turn")).union(closed.select("file", "start", "place", F.lit(-1)))


def _stitched(lines: DataFrame, sep: str, width: int) -> DataFrame:
    """Values of the lines (value, file, start, place), cut records put together again.

    Numbers of odd lines are stored first.  The lines of a large file are put in order block
    by block, by as many tasks; a record left open goes on in the next block.
    """
    odd = stored(_odd_lines(lines, sep), "odd-lines")
    if odd.isEmpty():
        return lines.select("value")
    turns = stored(_turns(odd, width), "turns")
    cut = turns.select("file").distinct()
    broken = lines.join(cut, "file", "left_semi")
    block, _, past = _windows()
    sums = broken.select("file", "start").distinct().join(
        turns.groupBy("file", "start").agg(F.sum("turn").alias("sum"), F.max(F.when(F.col("turn") == 1, F.struct("start", "place"))).alias("last")), ["file", "start"], "left"
    )
    carried = sums.select("file", "start", F.coalesce(F.sum("sum").over(past), F.lit(0)).alias("open"), F.last("last", True).over(past).alias("owner"))
    placed = broken.join(turns, ["file", "start", "place"], "left").join(carried, ["file", "start"])
    depth = F.col("open") + F.coalesce(F.sum("turn").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opener = F.coalesce(F.last(F.when(F.col("turn") == 1, F.struct("start", "place")), True).over(block), F.col("owner"))
    record = placed.select("value", "file", "start", "place", F.when((depth > 0) | (F.col("turn") == 1), opener).alias("record"))
    parts = record.where("record IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("p"))
    alone = lines.join(cut, "file", "left_anti").select("value").union(record.where("record IS NULL").select("value"))
    return alone.union(parts.select(F.array_join("p.value", "\n")))


def _parsed(lines: DataFrame, names: list[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines of one kind of file, and the lines with too many fields."""
    line = F.col("value")
    records = _stitched(lines, sep, len(names))
    closed = records.select(F.when(_quotes(line) % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line).alias("value"))
    fits = _fields(line, sep) <= len(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "multiLine": "true"}
    rows = closed.where(fits).select(F.from_csv(line, schema.toDDL(), options).alias("_r")).select("_r.*")
    return rows, closed.where(~fits)


def read_csv_tolerant(
    spark: SparkSession, path: str, separator: str | None = None, header: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """CSV files, repaired line by line; returns (rows, rejected lines).

    The first filled line of each file is its header, unless ``header`` gives the one that
    all lack; a byte order mark is passed over.  Each file's separator is chosen by its own
    first lines, unless given.  Columns are matched by name; a file without a column has NULL
    there.  A quoted separator or line break belongs to its field, also in headers of one
    line.  A line with an odd number of quotes gets a closing one; a line with too many
    fields is rejected, one with too few is filled with NULL.  Only the different pairs of
    header and separator come to the driver.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    text = spark.read.text(path).select("value", *at).withColumn("place", F.monotonically_increasing_id())
    marked = (F.col("start") == 0) & F.startswith("value", F.lit("\ufeff"))
    text = text.withColumn("value", F.when(marked, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))).where(F.trim("value") != "")
    seps = text.select("file").distinct().withColumn("sep", F.lit(separator)) if separator else _separators(text)
    if header is None:
        firsts = text.groupBy("file").agg(F.min(F.struct("start", "place", "value")).alias("f"))
        firsts = firsts.select("file", F.col("f.value").alias("header"), F.struct("f.start", "f.place").alias("_at"))
        lines = text.join(firsts.join(seps, "file"), "file").where(F.struct("start", "place") != F.col("_at"))
        kinds = firsts.join(seps, "file")
    else:
        lines, kinds = text.join(seps, "file").withColumn("header", F.lit(header)), seps.withColumn("header", F.lit(header))
    rows, rejected = [], []
    for kind in kinds.groupBy("header", "sep").agg(F.min("file").alias("f")).orderBy("f").collect():
        own = lines.where((F.col("header") == kind["header"]) & (F.col("sep") == kind["sep"])).select("value", "file", "start", "place")
        good, bad = _parsed(own, _names(kind["header"], kind["sep"]), kind["sep"])
        rows.append(good)
        rejected.append(bad)
    if not rows:
        raise ValueError(f"no lines in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), reduce(DataFrame.unionByName, rejected)


def _names(header: str, sep: str) -> list[str]:
    return [n.strip() for n in next(csv.reader([header], delimiter=sep, skipinitialspace=True))]


def read_json_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines; returns (rows, rejected lines).  Undecodable bytes become the replacement character."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = spark.read.text(path).select(
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_r"), "value"
    )
    good = parsed.where(F.col(f"_r.{CORRUPT}").isNull()).select(*[f"_r.{n}" for n in schema.names])
    return good, parsed.where(F.col(f"_r.{CORRUPT}").isNotNull()).select("value")


def read_run_batches(spark: SparkSession, folder: str, stamp: str, schema: T.StructType) -> DataFrame:
    """The JSON batch files of one run: those with its stamp in their name."""
    batches = spark.read.schema(schema).json(folder, pathGlobFilter=f"*{stamp}*")
    return batches.withColumn("_batch_file", F.col("_metadata.file_name"))


def list_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Path, size and time of each file; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "modificationTime")


def file_inventory(files: DataFrame, group: Column) -> DataFrame:
    """Number and total size of files per group."""
    return files.groupBy(group).agg(F.count("*").alias("object_count"), F.sum("length").alias("total_bytes"))


def find_files(
    files: DataFrame,
    name: str | None = None,
    extensions: tuple[str, ...] | None = IMAGE_EXTENSIONS,
    since: str | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Files by name part, extension and date; newest first, all of them or one page."""
    base = F.lower(F.substring_index("path", "/", -1))
    if extensions:
        files = files.where(F.substring_index(base, ".", -1).isin(*extensions))
    if name:
        files = files.where(base.contains(name.lower()))
    if since:
        files = files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    newest = files.orderBy(F.col("modificationTime").desc(), "path").offset(offset)
    return newest if limit is None else newest.limit(limit)


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
