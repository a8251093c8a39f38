"""Small rules over configuration."""

from __future__ import annotations

import pytest

from fernweave.config import ColumnGroup, Extraction, Relationship, SilverConfig
from fernweave.functions import coerce, paths, templates
from fernweave.operators.joins import UnlinkedTablesError, connected_components, join_order
from fernweave.operators.predicates import resolve, split_phases
from fernweave.operators.shape import prefixed_names, rename_clashes
from fernweave.plans.bronze import plan_bronze
from fernweave.plans.silver import NameClash, check_names
from fernweave.plans.unify import MappedGroup, SourceColumn, unified_columns
from fernweave.sources.files import vote_separator
from fernweave.sources.jdbc import jdbc_options


@pytest.mark.parametrize(
    ("types", "unified"),
    [
        ([], "string"), ([None, "int"], "int"), (["int", "bigint"], "bigint"), (["int", "double"], "string"),
        (["float", "double"], "double"), (["date", "timestamp"], "timestamp"), (["varchar", "date"], "string"),
    ],
)
def test_unify_types(types, unified):
    assert coerce.unify_types(types) == unified


@pytest.mark.parametrize(
    ("a", "b", "fits"),
    [("INT", "bigint", True), ("varchar(20)", "text", True), ("uuid", "GUID", True), ("uuid", "text", False), ("date", "date", True), ("int", "text", False)],
)
def test_types_joinable(a, b, fits):
    assert coerce.types_joinable(a, b) is fits


def test_phases_follow_the_six_rules():
    request = {
        "conditions": [
            {"column_name": "Flag"}, {"column_name": "unified"}, {"column_id": 1}, {"column_id": 2},
            {"column_name": "derived"}, {"column_id": 9, "column_name": "derived"}, {"column_name": "raw"},
        ]
    }
    got = split_phases(request, ["flag"], ["UNIFIED"], [1], [2], ["raw"])
    assert got.after_extract["conditions"] == [{"column_name": "Flag"}]
    assert got.after_transform["conditions"] == request["conditions"][1:5]
    assert got.before["conditions"] == request["conditions"][5:]


def test_or_over_several_phases_is_decided_once():
    request = {"logic": "OR", "conditions": [{"column_name": "raw"}, {"column_name": "flag"}]}
    got = split_phases(request, ["flag"], source_columns=["raw"])
    assert got.before is None and got.after_transform is None
    assert got.after_extract["conditions"] == request["conditions"]


def test_resolve_prefers_the_id():
    ids = {5: "a"}
    assert resolve({"column_id": 5, "column_name": "b"}, ["a", "b"], ids) == "a"
    assert resolve({"column_id": 6, "column_name": "b"}, ["a", "b"], ids) == "b"
    assert resolve({"column_name": "x"}, ["a"], ids) is None


LINKS = [Relationship("b", "k", "a", "k"), Relationship("b", "k", "c", "k"), Relationship("d", "k", "e", "k", active=False)]


def test_components_and_join_order():
    assert connected_components(["a", "b", "c", "d", "e"], LINKS) == [["a", "b", "c"], ["d"], ["e"]]
    start, steps = join_order(["a", "b", "c"], LINKS)
    assert start == "b" and [t for t, _ in steps] == ["a", "c"]
    with pytest.raises(UnlinkedTablesError, match="d"):
        join_order(["a", "b", "d"], LINKS)


def test_bronze_plan_names_groups_apart():
    plan = plan_bronze({"a": "X 1", "b": "X 1", "d": "X 1", "c": "y"}, LINKS)
    assert [(g.name, g.tables) for g in plan.groups] == [("part_x_1_0", ("a", "b")), ("part_x_1_1", ("d",)), ("part_y", ("c",))]
    assert [(r.left_table, r.right_table) for r in plan.links] == [("b", "c")]
    federated = plan_bronze({"a": "x", "b": "x", "c": "y"}, LINKS, federated=True)
    assert len(federated.groups) == 1 and not federated.links


def test_prefixed_names():
    names = prefixed_names({"a": ["id", "x"], "b": ["id", "y"]})
    assert names == {("a", "id"): "a_id", ("a", "x"): "x", ("b", "id"): "b_id", ("b", "y"): "y"}


def test_clashing_names_of_frames(spark):
    a = spark.createDataFrame([], "id int, x int, x_g int, _source_table string")
    b = spark.createDataFrame([], "ID int, X int, t_X int, _source_table string")
    frames, names = rename_clashes([("s", a), ("t", b)], join_columns=["id"])
    assert frames[0].columns == ["id", "s_x", "x_g", "_source_table"]
    assert frames[1].columns == ["ID", "g1_X", "t_X"] and names[1, "X"] == "g1_X"


def test_unified_columns_allocate_free_names():
    columns = [
        SourceColumn(1, "a", "key", "int"), SourceColumn(2, "b", "key", "bigint"), SourceColumn(3, "a", "note", "text"),
        SourceColumn(4, "b", "note", "text"), SourceColumn(5, "b", "note_b", "text"), SourceColumn(6, "b", "note", "text"),
    ]
    plan = unified_columns(columns, [MappedGroup("id", (2, 1))])
    assert [(u.name, u.type) for u in plan][:2] == [("id", "bigint"), ("note", "text")]
    assert [u.name for u in plan][2:] == ["note_b", "note_b_b", "note_b_1"]
    assert [c.id for c in plan[0].sources] == [2, 1]
    assert [u.name for u in unified_columns(columns, [], {3})] == ["note"]


@pytest.mark.parametrize(
    "config",
    [
        SilverConfig(1, groups=(ColumnGroup("x", ("a",)), ColumnGroup("X", ("b",)))),
        SilverConfig(1, groups=(ColumnGroup("A", ("b",)),)),
        SilverConfig(1, extractions=(Extraction("a", "B"),)),
        SilverConfig(1, extractions=(Extraction("a", "f"), Extraction("b", "F"))),
        SilverConfig(1, groups=(ColumnGroup("g", ("a",)),), extractions=(Extraction("a", "G"),)),
    ],
)
def test_name_clashes(config):
    with pytest.raises(NameClash):
        check_names(["a", "b"], config)


def test_group_may_carry_its_sources_name():
    check_names(["a", "b"], SilverConfig(1, groups=(ColumnGroup("A", ("a", "b")),)))


@pytest.mark.parametrize("text", ["{d3", "{x}", "{d3x}", "{}", "{?}"])
def test_bad_templates(text):
    assert templates.template_error(text)


@pytest.mark.parametrize("text", [*templates.DEFAULT_RULES.values(), '{"N"}{d?}', "plain"])
def test_good_templates(text):
    assert templates.template_error(text) is None


def test_template_escapes_its_literals():
    assert templates.parse_template(r"${d}\{d2}").replacement() == r"\$$1\\$2"


def test_safe_name():
    assert paths.safe_name("  Ação & Reação!  ") == "acao_reacao"
    assert paths.safe_name("") == paths.safe_name("***") == "unnamed"
    assert paths.safe_name("abc_def" * 4, 16) != paths.safe_name("abc_def" * 5, 16) and len(paths.safe_name("abc_def" * 4, 16)) <= 16


def test_identifiers():
    assert paths.identifier("My Base-1", 4) == "my_base_1_4"
    assert paths.identifier("1x") == "_1x" and paths.identifier("", 2) == "conn_2"
    assert paths.shared_table_name(" Relatório: 2ª via ") == "relatorio_2a_via" and paths.shared_table_name("--") == "table"


def test_unique_name():
    assert paths.unique_name("a", "x", set()) == "a"
    assert paths.unique_name("a", "x", {"a"}) == "a_x"
    assert paths.unique_name("a", "x", {"a", "a_x", "a_x_2"}) == "a_x_3"


def test_vote_separator():
    assert vote_separator(["a;b;c", "1,5;2;3", "4;5;6"]) == ";"
    assert vote_separator(["a\tb", "1\t2"]) == "\t"


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "SELECT 1")
    assert plain["query"] == "SELECT 1" and plain["fetchsize"] == "10000" and "numPartitions" not in plain
    split = jdbc_options("jdbc:x", "SELECT 1", split_on="id", bounds=(0, 9), partitions=4)
    assert split["dbtable"] == "(SELECT 1) q" and split["numPartitions"] == "4" and "query" not in split
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "SELECT 1", split_on="id")
