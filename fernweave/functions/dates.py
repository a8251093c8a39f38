"""Dates held as text: which columns hold them, and parsing that never fails the job.

Every value is parsed by the form it has itself.  Looking at a column only decides whether
it is a date column at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted date forms (name, pattern, format of the leading characters).
DATE_FORMS = (
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    ("iso-datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "yyyy-MM-dd"),
    ("dd/MM/yy", r"^\d{2}/\d{2}/\d{2}$", "dd/MM/yy"),
    ("dd-MM-yy", r"^\d{2}-\d{2}-\d{2}$", "dd-MM-yy"),
)
MIN_SHARE = 0.5


def detect_date_formats(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Text columns at least half of whose non-blank values have a date form, with the commonest form.

    One job over the whole columns.
    """
    if not columns:
        return {}
    measures = []
    for name in columns:
        value = F.trim(F.col(f"`{name}`"))
        hits = [F.count_if(value.rlike(pattern)).alias(form) for form, pattern, _ in DATE_FORMS]
        measures.append(F.struct(F.lit(name).alias("name"), F.count_if(value != "").alias("filled"), *hits).alias(name))
    one = df.agg(*measures)
    rows = one.select(F.explode(F.array(*[F.col(f"`{name}`") for name in columns])).alias("m")).select("m.*").where("filled > 0")
    found = {}
    for row in rows.collect():  # one row per requested column
        counts = {form: row[form] for form, _, _ in DATE_FORMS}
        if sum(counts.values()) >= MIN_SHARE * row["filled"]:
            found[row["name"]] = max(counts, key=counts.get)
    return found


def parse_any_date(c: Column) -> Column:
    """Text to date, each value by its own form; NULL where it has none or names no day."""
    value = F.trim(c)
    return F.coalesce(*[F.when(value.rlike(p), F.try_to_date(F.substring(value, 1, len(fmt)), fmt)) for _, p, fmt in DATE_FORMS])


def as_date(name: str, dtype: T.DataType, formats: dict[str, str]) -> Column | None:
    """The column as a date, or None when it holds no dates; ``formats`` names the text columns that do."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    if isinstance(dtype, T.StringType) and name in formats:
        return parse_any_date(c)
    return None


def _value_form(value: object) -> tuple[str, str] | None:
    """The text of a filter value's day and its format, or None; two-digit years are not accepted."""
    text = str(value).strip()
    forms = (fmt for _, pattern, fmt in DATE_FORMS if "yyyy" in fmt and re.match(pattern, text))
    fmt = next(forms, None)
    return (text[: len(fmt)], fmt) if fmt else None


def looks_like_date(value: object) -> bool:
    """Whether a filter value has a date form."""
    return _value_form(value) is not None


def date_literal(value: object) -> Column:
    """A filter value as a date: ISO date or datetime, ``dd/MM/yyyy`` or ``dd-MM-yyyy``."""
    found = _value_form(value)
    if found is None:
        raise ValueError(f"not a date: {str(value)!r}")
    return F.try_to_date(F.lit(found[0]), found[1])
