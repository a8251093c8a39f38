"""Rows and links out of HTML text, by pattern."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.arrays import explode_array

_ROW = r"(?s)<tr[^>]*\bdata-ri\b[^>]*>(.*?)</tr>"
_CELL = r"(?s)<td[^>]*>(.*?)</td>"
_LINK = r'(?is)<a\s[^>]*href="([^"]*)"'
_DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
_TOTAL = r"de\s+([0-9]+)\s+registros"


def plain_text(c: Column) -> Column:
    """Text without tags, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def record_cells(row: Column, fields: int) -> Column:
    """Cell texts of a table row from its first date-like cell on, padded to ``fields``; NULL without a date."""
    def from_date(cells: Column, first: Column) -> Column:
        rest = F.slice(cells, F.greatest(first, F.lit(1)).cast("int"), fields)
        padded = F.slice(F.concat(rest, F.array_repeat(F.lit(""), fields)), 1, fields)
        return F.when(first > 0, padded)

    def record(cells: Column) -> Column:
        dated = F.transform(cells, lambda x: x.rlike(_DATE))
        return _bind(F.array_position(dated, True), lambda first: from_date(cells, first))

    return _bind(F.transform(F.regexp_extract_all(row, F.lit(_CELL), F.lit(1)), plain_text), record)


def table_records(df: DataFrame, key: str, html: str, names: list[str]) -> DataFrame:
    """One record per dated row of the page's data tables."""
    rows = explode_array(df, [key], F.regexp_extract_all(F.col(html), F.lit(_ROW), F.lit(1)), "_row")
    # a row without a date gives no element, so nothing is parsed again by a filter
    record = _bind(record_cells(F.col("_row"), len(names)), lambda r: F.when(r.isNotNull(), F.array(r)))
    cells = explode_array(rows, [key], record, "_cells")
    return cells.select(key, *[F.col("_cells")[i].alias(n) for i, n in enumerate(names)])


def stated_total(html: Column) -> Column:
    """The total a page states ("de N registros"), else 0."""
    found = F.regexp_extract(plain_text(html), _TOTAL, 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """Every link target of a page, with its position."""
    return explode_array(df, [key], F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1)), "href", "position")
