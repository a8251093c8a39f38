"""Text changes a configuration asks for, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernweave.config import Transformation
from fernweave.functions import templates, text
from fernweave.operators.semantics import map_values

NAMED = {
    "lowercase": text.lowercase,
    "uppercase": text.uppercase,
    "trim": text.trim,
    "normalize_spaces": text.normalize_spaces,
    "remove_accents": text.remove_accents,
}


def python_rule(rule) -> Column:
    """A user's text rule as a vectorised function; a value it fails on passes unchanged."""
    def one(value: str | None) -> str | None:
        try:
            return None if value is None else rule(value)
        except Exception:  # noqa: BLE001 - a failing rule must not stop the job
            return value

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore").astype(object), T.StringType())


def apply_step(c: Column, step: Transformation) -> Column:
    """One change: a named step, template, rule, sql_regex, case_mapping or python_rule."""
    if step.kind in NAMED:
        return NAMED[step.kind](c)
    if step.kind == "template":
        return templates.rewrite(c.cast("string"), step.argument)
    if step.kind == "rule":
        return templates.normalise_by_rule(c, step.argument)
    if step.kind == "sql_regex":
        pattern, replacement = step.argument
        return F.regexp_replace(c, pattern, replacement)
    if step.kind == "case_mapping":
        return map_values(c, dict(step.argument))
    if step.kind == "python_rule":
        return python_rule(step.argument)(c.cast("string"))
    raise ValueError(f"unknown transformation {step.kind!r}")


def apply_steps(c: Column, steps: list[Transformation]) -> Column:
    for step in steps:
        c = apply_step(c, step)
    return c


def steps_by_column(
    steps: tuple[Transformation, ...], columns: list[str], column_ids: dict[int, str]
) -> dict[str, list[Transformation]]:
    """The steps of each known column, in order; steps for unknown columns are left out."""
    out: dict[str, list[Transformation]] = {}
    for step in steps:
        name = column_ids.get(step.column) if isinstance(step.column, int) else step.column
        if name in columns:
            out.setdefault(name, []).append(step)
    return out


def transform_columns(df, steps: tuple[Transformation, ...], column_ids: dict[int, str] | None = None):
    """Apply all steps in one projection."""
    plan = steps_by_column(steps, df.columns, column_ids or {})
    return df.select(*[apply_steps(F.col(f"`{c}`"), plan.get(c, [])).alias(c) for c in df.columns])

