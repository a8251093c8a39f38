"""Filters from requests: one condition builder, several request dialects."""

from __future__ import annotations

import decimal
import json
import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.functions.dates import as_date, date_literal, detect_date_formats, looks_like_date

_COMPARE: dict[str, Callable] = {
    "eq": operator.eq,
    "ne": operator.ne,
    "gt": operator.gt,
    "ge": operator.ge,
    "lt": operator.lt,
    "le": operator.le,
}

# Operator names each request dialect uses, and what they mean.
INLINE = {
    "=": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le",
    "LIKE": "like", "NOT LIKE": "not_like", "ILIKE": "ilike", "IN": "in", "NOT IN": "not_in",
    "IS NULL": "null", "IS NOT NULL": "not_null", "BETWEEN": "between",
}
GRID = {
    "eq": "eq", "neq": "ne", "gt": "gt", "gte": "ge", "lt": "lt", "lte": "le", "between": "between",
    "contains": "icontains", "not_contains": "not_icontains", "starts_with": "istarts", "ends_with": "iends",
    "is_null": "null", "is_not_null": "not_null", "in": "in", "not_in": "not_in",
}
BROWSER = {
    "eq": "eq", "neq": "ne", "gt": "gt", "gte": "ge", "lt": "lt", "lte": "le", "like": "like", "ilike": "ilike",
    "in": "in", "not_in": "not_in", "is_null": "null", "is_not_null": "not_null", "between": "between",
}
VIEWER = {
    "equals": "eq", "not_equals": "ne", "greater_than": "gt", "greater_than_equals": "ge", "less_than": "lt",
    "less_than_equals": "le", "contains": "contains", "starts_with": "starts", "ends_with": "ends", "in": "in",
    "is_null": "null", "is_not_null": "not_null",
}


class FilterError(ValueError):
    """A filter names an unknown column or operator, or a value that does not fit."""


def typed(value: object, dtype: T.DataType) -> Column:
    """A request value as a literal that compares with a column of this type."""
    if isinstance(dtype, T.NumericType) and isinstance(value, str):
        try:
            number = decimal.Decimal(value.strip())
        except decimal.InvalidOperation:
            raise FilterError(f"not a number: {value!r}") from None
        if not number.is_finite():
            if not isinstance(dtype, (T.FloatType, T.DoubleType)) or number.is_snan():
                raise FilterError(f"not a number of type {dtype.simpleString()}: {value!r}")
            return F.lit(float(number))
        if isinstance(dtype, T.DecimalType):
            return F.lit(number)
        return F.lit(int(number)) if number == number.to_integral_value() else F.lit(float(number))
    if isinstance(dtype, T.BooleanType) and isinstance(value, str):
        return F.lit(value.strip().lower() in ("true", "1"))
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
        return F.lit(value).try_cast(dtype)
    return F.lit(value)


def _as_list(value: object) -> list:
    """A list operand: a list, JSON text of one, or a single value."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            raise FilterError(f"not a list: {value!r}") from None
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def condition(c: Column, op: str, value: object, dtype: T.DataType, date: Column | None = None) -> Column:
    """One condition; ``date`` is the column as a date when comparisons are date-aware."""
    literal = date_literal if date is not None else (lambda v: typed(v, dtype))
    subject = c if date is None else date
    if op in _COMPARE:
        return _COMPARE[op](subject, literal(value))
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2 or None in value:
            raise FilterError("between needs two values")
        return subject.between(literal(value[0]), literal(value[1]))
    if op in ("in", "not_in"):
        if value is None:
            raise FilterError("a list of values is needed")
        member = subject.isin(*[literal(v) for v in _as_list(value)])
        return member if op == "in" else ~member
    if op in ("null", "not_null"):
        return c.isNull() if op == "null" else c.isNotNull()
    if value is None:
        raise FilterError(f"{op} needs a value")
    text, pattern = c.cast("string"), str(value)
    folded, low = F.lower(text), pattern.lower()
    tests = {
        "like": lambda: text.like(pattern),
        "not_like": lambda: ~text.like(pattern),
        "ilike": lambda: text.ilike(pattern),
        "contains": lambda: text.contains(pattern),
        "starts": lambda: text.startswith(pattern),
        "ends": lambda: text.endswith(pattern),
        "icontains": lambda: folded.contains(low),
        "not_icontains": lambda: ~folded.contains(low),
        "istarts": lambda: folded.startswith(low),
        "iends": lambda: folded.endswith(low),
    }
    if op not in tests:
        raise FilterError(f"unknown operator {op!r}")
    return tests[op]()


def resolve(cond: dict, columns: Iterable[str], column_ids: dict[int, str] | None = None) -> str | None:
    """The column a condition means: by id first, then by name; None when unknown."""
    have = set(columns)
    by_id = (column_ids or {}).get(cond.get("column_id"))
    for name in (by_id, cond.get("column_name"), cond.get("column")):
        if name in have:
            return name
    return None


def _operand(cond: dict, op: str) -> object:
    if op == "between" and "value_min" in cond:
        return [cond.get("value_min"), cond.get("value_max")]
    return cond["values"] if cond.get("values") is not None else cond.get("value")


def _all_dates(operand: object) -> bool:
    return all(map(looks_like_date, operand if isinstance(operand, (list, tuple, set)) else [operand]))


def combine(parts: list[Column], logic: str) -> Column:
    if logic.upper() not in ("AND", "OR"):
        raise FilterError(f"unknown logic {logic!r}")
    return reduce(operator.or_ if logic.upper() == "OR" else operator.and_, parts)


def filter_rows(
    df: DataFrame,
    request: dict | None,
    dialect: dict[str, str] = INLINE,
    column_ids: dict[int, str] | None = None,
    strict: bool = True,
    date_formats: dict[str, str] | None = None,
) -> DataFrame:
    """Keep the rows a ``{logic, conditions}`` request asks for.

    Comparisons treat date columns, and text columns with a format in ``date_formats``,
    as dates.  NULL never satisfies a comparison, ``!=`` or ``NOT IN``.  An unusable
    condition is an error unless ``strict=False``, which leaves it out.
    """
    parts = []
    for cond in (request or {}).get("conditions", []):
        try:
            name = resolve(cond, df.columns, column_ids)
            if name is None:
                raise FilterError(f"unknown column in {cond}")
            op = dialect.get(cond.get("operator", "="))
            if op is None:
                raise FilterError(f"unknown operator {cond.get('operator')!r}")
            dtype = df.schema[name].dataType
            date = as_date(name, dtype, date_formats) if date_formats is not None else None
            if isinstance(dtype, T.StringType) and not _all_dates(_operand(cond, op)):
                date = None  # a text column compares as dates only with date values
            parts.append(condition(F.col(f"`{name}`"), op, _operand(cond, op), dtype, date))
        except FilterError:
            if strict:
                raise
    return df.where(combine(parts, (request or {}).get("logic", "AND"))) if parts else df


def grid_filter(df: DataFrame, filters: list[dict], logic: str = "AND") -> DataFrame:
    """Grid filter: case-insensitive text tests and date-aware comparisons.

    Text columns compared with date values are examined, all in one job, to find the
    ones that hold dates; their values may differ in form.  Other filter values need no such
    look at the data.
    """
    aware = {*_COMPARE, "between", "in", "not_in"}

    def may_hold_dates(f: dict) -> bool:
        if f["column"] not in df.columns or GRID.get(f["operator"]) not in aware:
            return False
        return isinstance(df.schema[f["column"]].dataType, T.StringType) and _all_dates(f.get("value"))

    texts = sorted({f["column"] for f in filters if may_hold_dates(f)})
    formats = detect_date_formats(df, texts)
    return filter_rows(df, {"logic": logic, "conditions": filters}, GRID, date_formats=formats)


# Predicate tree operators, and the type names of its literals.
_TREE_COMPARE = {
    "equal": "eq",
    "lessThan": "lt",
    "lessThanOrEqual": "le",
    "greaterThan": "gt",
    "greaterThanOrEqual": "ge",
}
_TREE_TYPES = {
    "string": "string", "int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double",
    "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz",
}


def predicate_tree(df: DataFrame, node: dict) -> Column:
    """A condition from a nested ``{op, children, name, value, valueType}`` request."""
    op, children = node.get("op"), node.get("children", [])
    if op == "column":
        if node.get("name") not in df.columns:
            raise FilterError(f"unknown column {node.get('name')!r}")
        return F.col(f"`{node['name']}`")
    if op == "literal":
        dtype = _TREE_TYPES.get(node.get("valueType", "string"))
        if dtype is None:
            raise FilterError(f"unknown literal type {node.get('valueType')!r}")
        return F.lit(str(node.get("value"))).try_cast(dtype)
    arity = {**dict.fromkeys(_TREE_COMPARE, 2), "isNull": 1, "not": 1}.get(op)
    if (arity is None and op not in ("and", "or")) or (arity and len(children) != arity) or not children:
        raise FilterError(f"cannot use predicate {op!r} with {len(children)} children")
    built = [predicate_tree(df, child) for child in children]
    if op in _TREE_COMPARE:
        return _COMPARE[_TREE_COMPARE[op]](*built)
    if op == "isNull":
        return built[0].isNull()
    return ~built[0] if op == "not" else combine(built, op)


def dict_filter(df: DataFrame, wanted: dict[str, object]) -> tuple[DataFrame, list[str]]:
    """``{column: value or list}`` equality; returns the rows and the unknown columns left out."""
    unknown = [n for n in wanted if n not in df.columns]
    for name, value in wanted.items():
        if name not in unknown:
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            df = df.where(F.col(name).isin(*values))
    return df, unknown


def expression_filter(df: DataFrame, where: str) -> DataFrame:
    """A SQL condition over the columns."""
    return df.where(F.expr(where))


def ambiguous_filter(df: DataFrame, copies: list[str], op: str, value: object) -> DataFrame:
    """Filter on a name that several tables have: the first copy that holds a value counts."""
    return df.where(condition(F.coalesce(*[F.col(c) for c in copies]), op, value, df.schema[copies[0]].dataType))


def present_rows(df: DataFrame, key: str, digits_only: bool = False) -> DataFrame:
    """Rows with a usable key."""
    text = F.trim(F.col(key).cast("string"))
    return df.where(text.rlike(r"^[0-9]+$") if digits_only else text != "")


def keyword_search(df: DataFrame, keyword: str, columns: list[str], exact: dict[str, object] | None = None) -> DataFrame:
    """Rows where any column contains the keyword, ignoring case, and the exact filters hold."""
    hit = combine([F.lower(F.col(c).cast("string")).contains(keyword.lower()) for c in columns], "OR")
    return dict_filter(df.where(hit), exact or {})[0]


@dataclass(frozen=True)
class FilterPhases:
    """A request split by when its conditions can be applied."""

    before: dict | None
    after_transform: dict | None
    after_extract: dict | None


def split_phases(
    request: dict | None,
    extracted: Iterable[str] = (),
    unified: Iterable[str] = (),
    transformed: Iterable[str | int] = (),
    dropped_sources: Iterable[str | int] = (),
    source_columns: Iterable[str] | None = None,
) -> FilterPhases:
    """When each condition applies: raw columns first, then unified or transformed, then extracted."""
    extracted, unified = ({n.lower() for n in names} for names in (extracted, unified))
    changed = {*transformed, *dropped_sources}
    known = None if source_columns is None else {n.lower() for n in source_columns}
    phases: dict[str, list[dict]] = {"before": [], "after_transform": [], "after_extract": []}
    for cond in (request or {}).get("conditions", []):
        raw_name = cond.get("column_name") or ""
        name, cid = raw_name.lower(), cond.get("column_id")
        derived = known is not None and bool(name) and name not in known and cid is None
        if name and name in extracted:
            phase = "after_extract"
        elif (name and name in unified) or cid in changed or raw_name in changed or derived:
            phase = "after_transform"
        else:
            phase = "before"
        phases[phase].append(cond)
    logic = (request or {}).get("logic", "AND")
    if logic.upper() == "OR" and sum(map(bool, phases.values())) > 1:
        # an OR over several phases can only be decided once every column exists
        last = "after_extract" if phases["after_extract"] else "after_transform"
        phases = {k: (list(request["conditions"]) if k == last else []) for k in phases}
    return FilterPhases(**{k: {"logic": logic, "conditions": v} if v else None for k, v in phases.items()})
