"""Filters against a plain Python evaluation of the same conditions."""

from __future__ import annotations

import datetime as dt
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fernweave.operators import predicates as p

ROWS = [
    (1, "Ana", 10, 1.5, dt.date(2024, 1, 5)), (2, "bob", None, 2.5, dt.date(2024, 2, 1)), (3, None, 30, None, None),
    (4, "Anabel", -5, 0.0, dt.date(2023, 12, 31)), (5, "a%b_c", 10, -1.0, dt.date(2024, 1, 5)), (6, "", 0, 99.25, dt.date(2024, 3, 1)),
]
NAMES = ["id", "s", "n", "x", "d"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, s string, n int, x double, d date")


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def expected(conditions, logic):
    """SQL three-valued logic by hand: None is unknown."""
    def one(row, c):
        value, op = row[NAMES.index(c["column_name"])], c["operator"]
        if op in ("IS NULL", "IS NOT NULL"):
            return (value is None) == (op == "IS NULL")
        if value is None:
            return None
        if op == "BETWEEN":
            return c["value_min"] <= value <= c["value_max"]
        if op in ("IN", "NOT IN"):
            return (value in c["value"]) == (op == "IN")
        return COMPARE[op](value, c["value"])

    def all_of(parts):
        return False if False in parts else None if None in parts else True

    def any_of(parts):
        return True if True in parts else None if None in parts else False

    fold = any_of if logic == "OR" else all_of
    return [r[0] for r in ROWS if fold([one(r, c) for c in conditions]) is True]


NUMBER = st.sampled_from([-5, 0, 1, 10, 30])
CONDITION = st.one_of(
    st.builds(lambda o, v: {"column_name": "n", "operator": o, "value": v}, st.sampled_from(list(COMPARE)), NUMBER),
    st.builds(lambda o, v: {"column_name": "s", "operator": o, "value": v}, st.sampled_from(["=", "!=", ">", "<"]), st.sampled_from(["Ana", "bob", "z"])),
    st.builds(lambda a, b: {"column_name": "n", "operator": "BETWEEN", "value_min": a, "value_max": b}, NUMBER, NUMBER),
    st.builds(lambda o, v: {"column_name": "n", "operator": o, "value": v}, st.sampled_from(["IN", "NOT IN"]), st.lists(NUMBER, min_size=1, max_size=3)),
    st.builds(lambda c, o: {"column_name": c, "operator": o}, st.sampled_from(NAMES), st.sampled_from(["IS NULL", "IS NOT NULL"])),
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(conditions=st.lists(CONDITION, min_size=1, max_size=4), logic=st.sampled_from(["AND", "OR"]))
def test_inline_filter_follows_three_valued_logic(df, conditions, logic):
    assert ids(p.filter_rows(df, {"logic": logic, "conditions": conditions})) == expected(conditions, logic)


def inline(df, column, op, value=None, **kwargs):
    return ids(p.filter_rows(df, {"conditions": [{"column_name": column, "operator": op, "value": value}]}, **kwargs))


def test_text_numbers_take_the_columns_type(df):
    assert inline(df, "n", ">", "9.5") == [1, 3, 5]
    assert inline(df, "n", "IN", '["10", "0"]') == [1, 5, 6]
    assert inline(df, "s", "=", 10) == []  # a number against text compares as text, without failing


def test_like_keeps_its_wildcards_and_contains_does_not(df):
    assert inline(df, "s", "LIKE", "A%") == [1, 4]
    assert inline(df, "s", "ILIKE", "a%") == [1, 4, 5]
    assert ids(p.filter_rows(df, {"conditions": [{"column": "s", "operator": "contains", "value": "%"}]}, p.VIEWER)) == [5]


def test_unusable_conditions_raise_or_are_left_out(df):
    for column, op, value in (("nope", "=", 1), ("n", "~", 1), ("n", "=", "abc"), ("n", "IN", "not json"), ("n", "BETWEEN", None)):
        with pytest.raises(p.FilterError):
            inline(df, column, op, value)
        assert inline(df, column, op, value, strict=False) == [1, 2, 3, 4, 5, 6]


def grid(df, column, op, value=None):
    return ids(p.grid_filter(df, [{"column": column, "operator": op, "value": value}]))


def test_grid_filter(df):
    assert grid(df, "s", "contains", "ANA") == [1, 4]
    assert grid(df, "s", "not_contains", "ana") == [2, 5, 6]
    assert grid(df, "n", "starts_with", "1") == [1, 5]
    assert grid(df, "s", "ends_with", "B") == [2]
    assert grid(df, "d", "eq", "05/01/2024") == [1, 5]
    assert grid(df, "d", "not_in", ["2024-01-05T10:00:00", "31-12-2023"]) == [2, 6]
    assert grid(df, "d", "between", ["2024-01-01", "2024-02-01"]) == [1, 2, 5]
    with pytest.raises(p.FilterError):
        grid(df, "s", "contains")
    with pytest.raises(p.FilterError):
        grid(df, "d", "between", ["2024-01-01"])
    with pytest.raises(ValueError):
        grid(df, "d", "eq", "yesterday")


def test_predicate_tree_errors(df):
    column, literal = {"op": "column", "name": "n"}, {"op": "literal", "value": "1", "valueType": "int"}
    bad = [
        {"op": "equal", "children": [column]}, {"op": "xor", "children": [column, literal]}, {"op": "and", "children": []},
        {"op": "column", "name": "nope"}, {"op": "literal", "value": "1", "valueType": "blob"}, {},
    ]
    for node in bad:
        with pytest.raises(p.FilterError):
            p.predicate_tree(df, node)


def test_predicate_literals_cannot_inject(df):
    node = {"op": "equal", "children": [{"op": "column", "name": "s"}, {"op": "literal", "value": "' OR 1=1 --", "valueType": "string"}]}
    assert ids(df.where(p.predicate_tree(df, node))) == []


def test_dict_filter_reports_unknown_columns(df):
    rows, unknown = p.dict_filter(df, {"n": [10, 30], "nope": 1})
    assert ids(rows) == [1, 3, 5] and unknown == ["nope"]


def test_text_dates_compare_as_dates_only_with_dates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, '02/01/2024'), (2, '01/02/2024'), (3, 'none') AS t(id, day)")
    assert grid(df, "day", "lt", "2024-01-15") == [1]
    assert grid(df, "day", "eq", "none") == [3]
    assert grid(df, "day", "in", ["none", "02/01/2024"]) == [1, 3]


@pytest.mark.parametrize("value", ["Infinity", "-inf", "NaN", "sNaN"])
def test_values_without_end_fit_floating_columns_only(spark, value):
    df = spark.sql("SELECT 1 AS n, CAST(1.5 AS decimal(4, 1)) AS d, double('Infinity') AS f UNION ALL SELECT 2, 2.5, 3.0")
    for column in ("n", "d"):
        with pytest.raises(p.FilterError, match="not a number"):
            p.typed(value, df.schema[column].dataType)
    if value == "sNaN":
        with pytest.raises(p.FilterError, match="not a number"):
            p.typed(value, df.schema["f"].dataType)
    else:
        assert df.where(df["f"] == p.typed(value, df.schema["f"].dataType)).count() == (value == "Infinity")
