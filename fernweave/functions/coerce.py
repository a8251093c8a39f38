"""Type rules: safe casts, missing tokens, yes/no text, schema reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for a missing value.
MISSING_WORDS = ("nan", "nat", "none", "null", "")

# Words read as true and as false.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n", "", "nan", "none", "null")

# Type name in a unified column definition and the Spark type it becomes.
TARGET_TYPES = {
    "string": "string",
    "text": "string",
    "integer": "int",
    "int": "int",
    "bigint": "bigint",
    "boolean": "boolean",
    "float": "double",
    "double": "double",
    "decimal": "decimal(38,10)",
    "date": "date",
    "timestamp": "timestamp",
    "datetime": "timestamp",
}

# Type families; only types of one family unify without becoming text.
TYPE_FAMILIES = (
    ("string", "text", "varchar"),
    ("integer", "int", "bigint"),
    ("decimal", "numeric", "float", "double"),
    ("boolean",),
    ("date", "timestamp", "datetime"),
)

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)


def target_type(name: str | None) -> str:
    return TARGET_TYPES.get((name or "").lower(), "string")


def unify_types(names: list[str | None]) -> str:
    """One type for a unified column: the shared type, the widest of its family, or text."""
    types = sorted({n.lower() for n in names if n})
    if len(types) <= 1:
        return types[0] if types else "string"
    for family in TYPE_FAMILIES:
        if all(t in family for t in types):
            return max(types, key=family.index)
    return "string"


def types_joinable(left: str, right: str) -> bool:
    """Whether two catalog type names may be compared as join keys."""
    a, b = left.lower(), right.lower()
    # Names per family.
    integers = {"int", "integer", "bigint", "smallint", "tinyint", "int4", "int8", "int2"}
    texts = ("varchar", "char", "text", "string", "nvarchar", "nchar")
    ids = {"uuid", "guid", "uniqueidentifier"}
    both_text = any(t in a for t in texts) and any(t in b for t in texts)
    return a == b or {a, b} <= integers or {a, b} <= ids or both_text


def types_joinable_column(a: Column, b: Column) -> Column:
    """The same rule on two columns of type names."""
    a, b = F.lower(a), F.lower(b)
    integers = ["int", "integer", "bigint", "smallint", "tinyint", "int4", "int8", "int2"]
    ids = ["uuid", "guid", "uniqueidentifier"]
    text = "char|text|string"
    return (a == b) | (a.isin(integers) & b.isin(integers)) | (a.isin(ids) & b.isin(ids)) | (a.rlike(text) & b.rlike(text))


def lake_safe(c: Column, dtype: T.DataType) -> Column:
    """A column in a type every lake table can hold."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if isinstance(dtype, T.TimestampType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType, T.NullType)):
        return c.cast("string")
    return c


def lake_safe_frame(df: DataFrame) -> DataFrame:
    return df.select(*[lake_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def serialise(c: Column, dtype: T.DataType) -> Column:
    """Text form for delivery: JSON for anything nested, a plain cast otherwise."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(dtype, T.BinaryType) else c.cast("string")


def missing_to_null(c: Column) -> Column:
    """Words that stand for "missing" become NULL; everything else becomes text."""
    text = c.cast("string")
    return F.when(~F.lower(text).isin(*MISSING_WORDS), text)


def clean_missing(df: DataFrame, columns: list[str], fill_empty: bool = True) -> DataFrame:
    """Missing words to NULL; a column with no value at all becomes empty text.

    "No value at all" is a fact about the whole table, so it comes from one extra
    aggregate joined in as scalar subqueries.
    """
    cleaned = {n: missing_to_null(F.col(n)) for n in columns}
    if not fill_empty:
        return df.withColumns(cleaned)
    found = df.agg(*[F.count(c).alias(n) for n, c in cleaned.items()])
    return df.withColumns(
        {n: F.when(found.select(n).scalar() == 0, F.lit("")).otherwise(c) for n, c in cleaned.items()}
    )


def to_number(c: Column, dtype: str = "double", default: object = 0) -> Column:
    """Number from anything; what does not convert takes the default."""
    return F.coalesce(c.try_cast(dtype), F.lit(default).cast(dtype))


def to_flag(c: Column) -> Column:
    """Yes/no text to boolean; unknown words and NULL count as no."""
    word = F.lower(F.trim(c.cast("string")))
    return F.coalesce(word.isin(*TRUE_WORDS), F.lit(False))


def flag_like_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Text columns whose every value is a yes/no word (one aggregate over all of them)."""
    words = [*TRUE_WORDS, *FALSE_WORDS]
    tests = [F.bool_and(F.coalesce(F.lower(F.trim(F.col(n))).isin(*words), F.lit(True))).alias(n) for n in columns]
    row = df.agg(*tests).first()
    return [n for n in columns if row[n]]


def cast_flag_like(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn yes/no text columns into booleans."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = flag_like_columns(df, columns or texts)
    return df.withColumns({n: to_flag(F.col(n)) for n in found}) if found else df


def _default(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, INTEGERS + FRACTIONS):
        return F.lit(0).cast(dtype)
    return F.lit(None).cast(dtype)


def reconcile(new: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring new rows to an existing table's schema.

    Shared columns take the existing type, absent ones its default, and columns only
    the new rows have are kept at the end.
    """
    have = {f.name: f for f in new.schema}
    out = []
    for field in schema:
        if field.name not in have:
            value = _default(field.dataType)
        else:
            c, now = F.col(field.name), have[field.name].dataType
            if now == field.dataType:
                value = c
            elif isinstance(field.dataType, T.BooleanType):
                value = to_flag(c)
            elif isinstance(field.dataType, INTEGERS) and not isinstance(now, INTEGERS):
                whole = c.try_cast("decimal(38,6)").try_cast(field.dataType)
                value = F.coalesce(whole, _default(field.dataType))
            elif isinstance(field.dataType, FRACTIONS):
                value = F.coalesce(c.try_cast(field.dataType), _default(field.dataType))
            else:
                value = c.try_cast(field.dataType)
        out.append(value.alias(field.name))
    known = set(schema.names)
    return new.select(*out, *[F.col(n) for n in new.columns if n not in known])
