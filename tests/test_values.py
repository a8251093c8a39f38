"""Functions on single values, checked against plain Python."""

from __future__ import annotations

import unicodedata
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.functions import coerce, dates, html, paths, templates, text
from fernweave.operators.quantiles import exact_quantile, exact_quantiles

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def apply(spark, values, fn):
    return [r[0] for r in column(spark, values).orderBy("i").select(fn(F.col("v"))).collect()]


SAMPLES = ["Élan d'été", "o'neil-SMITH  jr", "", "a\tb\n c", "ÀÉ ñandú x9", "12.345/67", None]


@pytest.mark.parametrize(
    ("step", "python"),
    [
        ("digits_only", lambda v: re.sub("[^0-9]", "", v)), ("letters_only", lambda v: re.sub("[^a-zA-Z]", "", v)),
        ("alphanumeric", lambda v: re.sub("[^a-zA-Z0-9]", "", v)), ("no_spaces", lambda v: v.replace(" ", "")), ("strip", str.strip),
        ("uppercase", str.upper), ("lowercase", str.lower), ("capitalize", str.capitalize), ("title", str.title), ("swapcase", str.swapcase),
        ("normalize_spaces", lambda v: " ".join(v.split())),
    ],
)
def test_preprocessors_follow_python(spark, step, python):
    got = apply(spark, SAMPLES, lambda c: text.preprocess(c, step))
    assert got == [None if v is None else python(v) for v in SAMPLES]


def test_accents(spark):
    assert apply(spark, ["ação É", "ẽ"], text.remove_accents) == ["acao E", "ẽ"]
    assert apply(spark, ["ação É", "ẽ", None], text.remove_all_accents) == ["acao E", "e", None]


def test_all_accents_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    values = ["plain", "", None, "Ångström ǖ ẽ̱", "한국 Ω K", "a\u0300b", "e\u0327\u0301"]
    want = [None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not "\u0300" <= c <= "\u036f") for v in values]
    assert apply(spark, values, text.remove_all_accents) == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000



@pytest.mark.parametrize(
    ("rule", "value", "want"),
    [
        ("cpf_formatado", "111222333-44", "111.222.333-44"), ("cpf_limpo", "111.222.333-44", "11122233344"),
        ("cnpj_formatado", "11222333444455", "11.222.333/4444-55"), ("cnpj_limpo", "11.222.333/4444-55", "11222333444455"),
        ("telefone_formatado", "11 91234 5678", "(11) 91234-5678"), ("telefone_fixo_formatado", "1112345678", "(11) 1234-5678"),
        ("telefone_e164", "(11) 91234-5678", "+5511912345678"), ("cep_formatado", "12345678", "12345-678"), ("cep_limpo", "12345-678", "12345678"),
        ("data_iso", "2024/01/02", "2024-01-02"), ("data_br", "02-01-2024", "02/01/2024"), ("placa_antiga", "abc 1234", "ABC-1234"),
        ("placa_mercosul", "abc-1d23", "ABC1D23"), ("cpf_limpo", "123", None), ("cep_limpo", "", None), ("cep_limpo", None, None),
    ],
)
def test_default_rules(spark, rule, value, want):
    assert apply(spark, [value], lambda c: templates.normalise_by_rule(c, rule)) == [want]


@pytest.mark.parametrize(
    ("template", "value", "strict", "loose"),
    [
        ("{d3}", "12345", None, "123"),  # more input than the template takes
        ("{L2}-{d}", "abc1", None, "ABC-1"),  # a counted capital slot
        ("{d3?}-{d2}", "1234", None, "12-34"),  # 0 or 3 digits against 0 to 3
        ("{d3?}-{d2}", "12345", "123-45", "123-45"),
        ("{d3?}-{d2}", "45", "-45", "-45"),
        ("{l2}{D}", "AB123", "ab123", "ab123"),
        ('{"X-"}{W}', "a_1", "X-a1", "X-a1"),
        ("{w2}", "a", None, None),
    ],
)
def test_strict_and_loose_templates(spark, template, value, strict, loose):
    assert apply(spark, [value], lambda c: templates.normalise(c, template)) == [strict]
    assert apply(spark, [value], lambda c: templates.normalise(c, template, prefix=True)) == [loose]


def test_rewrite_passes_what_does_not_fit(spark):
    got = apply(spark, ["12345678901", "1234567890", "x", None], lambda c: templates.rewrite(c, "{d3}.{d3}.{d3}-{d2}"))
    assert got == ["123.456.789-01", "1234567890", "x", None]
    assert apply(spark, ["12"], lambda c: templates.rewrite(c, "${d}\\{d}")) == ["$1\\2"]


def test_unknown_step_and_rule():
    with pytest.raises(ValueError):
        templates.normalise_by_rule(None, "no_such_rule")
    with pytest.raises(ValueError):
        text.preprocess(None, "no_such_step")


def test_date_forms_vote(spark):
    df = spark.createDataFrame(
        [("01/02/2024", "2024-01-02", "x", "01-02-24", ""), ("03/02/2024", "2024-13-99", "y", "05-02-24", " "), ("bad", "z", "z", "06/02/24", None)],
        "a string, b string, c string, d string, e string",
    )
    assert dates.detect_date_formats(df, df.columns) == {"a": "dd/MM/yyyy", "b": "yyyy-MM-dd", "d": "dd-MM-yy"}
    parsed = df.select(dates.parse_any_date(F.col("a")), dates.parse_any_date(F.col("b"))).collect()
    assert [str(v) for v in parsed[0]] == ["2024-02-01", "2024-01-02"]
    assert parsed[1][1] is None and parsed[2][0] is None  # no failure under ANSI rules


def test_half_of_the_samples_is_enough(spark):
    df = spark.createDataFrame([("2024-01-02",), ("x",)], "a string")
    assert dates.detect_date_formats(df, ["a"]) == {"a": "yyyy-MM-dd"}


def test_the_whole_column_decides(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 25, "01/02/2024").otherwise("junk").alias("a"))
    assert dates.detect_date_formats(df, ["a"]) == {}


def test_no_row_of_a_rarer_form_is_lost(spark):
    from fernweave.operators.predicates import grid_filter

    df = spark.createDataFrame([(f"0{i}/02/1998",) for i in range(1, 7)] + [(f"0{i}-02-1998",) for i in range(1, 5)], "day string")
    assert grid_filter(df, [{"column": "day", "operator": "gte", "value": "1997-01-01"}]).count() == 10


def test_mixed_date_forms(spark):
    got = apply(spark, ["01/02/2024", "2024-02-01T10:00:00Z", "01-02-24", "x"], dates.parse_any_date)
    assert [str(v) for v in got] == ["2024-02-01", "2024-02-01", "2024-02-01", "None"]


def test_missing_and_flags(spark):
    assert apply(spark, ["NaN", "NULL", " null ", "x", "", None], coerce.missing_to_null) == [None, None, " null ", "x", None, None]
    assert apply(spark, ["Yes", " 1", "n", "maybe", None], coerce.to_flag) == [True, True, False, False, False]
    assert apply(spark, ["1.5", "x", None], coerce.to_number) == [1.5, 0.0, 0.0]


def test_reconcile(spark):
    old = spark.createDataFrame([], "a int, b boolean, c double, d string, e date").schema
    new = spark.createDataFrame([("7.9", "yes", "x", 5)], "a string, b string, c string, extra int")
    out = coerce.reconcile(new, old)
    assert out.columns == ["a", "b", "c", "d", "e", "extra"]
    assert tuple(out.first()) == (7, True, 0.0, "", None, 5)


def test_paths(spark):
    assert apply(spark, ["a/b.JPG?x=1", "a.b/c", None], paths.media_type) == ["image/jpeg", "application/octet-stream", "application/octet-stream"]
    assert apply(spark, ["s3://b/x/y.png", "", None], lambda c: paths.asset_path(c, "p/")) == ["p/y.png", None, None]
    assert apply(spark, ["Ação & x!", "***", None, "日本"], paths.safe_name_column) == ["acao_x", "unnamed", "unnamed", "unnamed"]


def test_table_rows_from_html(spark):
    page = (
        "<table><tr data-ri='0'><td>#</td><td>02/01/2024</td><td>a <b>b</b></td></tr>"
        "<tr><td>03/01/2024</td></tr><tr data-ri=1><td>none</td></tr>"
        "<tr class='x' data-ri=\"2\">\n<td>04/01/2024</td><td>1</td><td>2</td><td>3</td></tr></table> 1-2 de 17 registros"
    )
    df = column(spark, [page])
    rows = html.table_records(df, "i", "v", ["day", "x", "y"]).orderBy("day").collect()
    assert [tuple(r)[1:] for r in rows] == [("02/01/2024", "a b", ""), ("04/01/2024", "1", "2")]
    assert apply(spark, [page, "none"], html.stated_total) == [17, 0]


@FEW
@given(values=st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 7.0])), min_size=1, max_size=60), q=st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantile_follows_numpy(spark, values, q):
    import numpy as np

    df = column(spark, values, "double")
    assert exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


def test_exact_quantile_of_a_large_skewed_column(spark):
    import numpy as np

    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.col("id").cast("double"), 2)).alias("v"))
    values = np.array([5.0 if i % 3 == 0 else float(i) ** 2 for i in range(60_000)])
    for q in (0.1, 0.5, 0.77):
        assert exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q))
    assert exact_quantile(df.where("v < 0"), "v") is None


def test_exact_quantile_of_infinities_nan_outliers_and_large_integers(spark):
    n = 20_001
    df = spark.range(n).selectExpr(
        "if(id = 7, double('Infinity'), double(id)) AS inf", "if(id % 10 = 0, double('NaN'), double(id)) AS nan", "if(id < 3, 1e300, double(id)) AS far",
        "9007199254740992 + id AS big", "cast(id AS decimal(30,2)) / 4 AS dec", "if(id % 3 = 0, NULL, int(id)) AS gaps",
    )
    got = exact_quantiles(df, df.columns)
    assert got["inf"] == 10001.0 and got["far"] == 10003.0 and got["big"] == 9007199254740992 + 10000
    assert got["nan"] == sorted(float(i) for i in range(n) if i % 10)[n // 2] and float(got["dec"]) == 2500.0
    gaps = [i for i in range(n) if i % 3]
    assert got["gaps"] == (gaps[len(gaps) // 2 - 1] + gaps[len(gaps) // 2]) / 2
    assert exact_quantile(df.where("nan is NULL"), "nan") is None


@pytest.mark.parametrize(
    "value",
    ["id % 2", "if(id * 200 < 99 * 30000, 0, 1)", "if(id * 100 < 49 * 30000, 0, 1)", "if(id * 100 < 48 * 30000, 0, 1)", "7", "id % 3", "if(id < 15000, -1, id)",
     "double(if(id % 2 = 0, 'NaN', '1'))", "if(id < 14999, double('-Infinity'), double('Infinity'))", "cast(id % 2 AS decimal(20,4)) / 3", "if(id < 15000, 0.0D, -0.0D)", "id DIV 10"],
)
def test_quantiles_of_ties_end_in_few_passes(spark, value):
    """Flags, constants, even and nearly even splits: every pass drops both cut values."""
    from fernweave.operators.quantiles import select_ranks

    df = spark.range(30_000).selectExpr(f"{value} AS v")
    order = lambda x: (x != x, 0 if x != x else x)
    values = sorted((r["v"] for r in df.collect()), key=order)
    ranks = [("v", r) for r in (0, 7_499, 14_999, 15_000, 29_999)]
    found, passes = select_ranks(df, {"v": len(values)}, ranks, sample=500)
    assert passes <= 5
    assert [order(found[r]) for r in ranks] == [order(values[r]) for _, r in ranks]


def test_profile_of_flag_columns_ends(spark):
    from fernweave.operators.aggregates import column_profile, number_statistics

    df = spark.range(20_000).selectExpr("id % 2 AS even", "if(id * 200 < 99 * 20000, 0, 1) AS near", "3 AS same")
    medians = {r["column_name"]: r["median"] for r in column_profile(df).collect()}
    assert medians == {"even": 0.5, "near": 1.0, "same": 3.0}
    assert number_statistics(df, "even").first()["median"] == 0.5


def test_jobs_of_a_profile_do_not_follow_the_columns(spark):
    from fernweave.operators.aggregates import column_profile

    def jobs(n: int) -> int:
        tracker, group = spark.sparkContext.statusTracker(), f"profile-{n}"
        spark.sparkContext.setJobGroup(group, group)
        column_profile(spark.range(500).selectExpr(*[f"id * {i + 1} AS c{i}" for i in range(n)])).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(12) <= jobs(2) + 1
