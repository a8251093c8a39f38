"""Near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tests.llm.conftest import ODD, documents
from tests.parity import compare, oracle_connection

from fernweave.llm import near_dedup, queries
from fernweave.llm.components import connected_components


def groups(rows: list, words: int = 4, percent: int = 80) -> dict:
    """Least id reachable, by comparing all pairs."""
    sets = {}
    for key, text in rows:
        t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[key] = {tuple(t[i : i + words]) for i in range(len(t) - words + 1)} if len(t) >= words else {tuple(t)} if t else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def family(seed: int = 3) -> list:
    """Chains of edits, copies, and texts around one long common passage."""
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=60)
    rows = []
    for _ in range(6):
        text = draw.choices(vocabulary, k=70)
        for step in range(8):
            rows.append(" ".join(text))
            text = list(text)
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
    for i in range(60):
        rows.append(" ".join([f"own{i}a", *passage, *(f"own{i}{c}" for c in "bcdefghijk")]))
        if i % 10 == 0:
            rows.append(" ".join([f"own{i}a", *passage, *(f"own{i}{c}" for c in "bcdefghij")]))
    rows += [rows[0].upper(), rows[0], "a b", "A  b", "a", ""]
    draw.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = family(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    want = groups(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_against_sql(spark, small):
    assert compare(oracle_connection(small), queries.op8_near_dedup(spark, small), queries.ORACLES["op8_near_dedup"]) == []


def test_rows_of_any_kind(spark, odd, empty):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    verdict = {k: (c, kept) for k, _, c, kept in got if k != "None"}
    assert len(got) == len(ODD)
    assert verdict["1"] == (1, True) and verdict["6"] == (1, False) and verdict["2"] == (2, True) and verdict["7"] == (7, True)
    assert [(n, c, kept) for k, n, c, kept in got if k == "None"] == [(0, None, True), (5, None, True)]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0
    left = near_dedup.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "5", "7", "None", "None"]


def test_one_of_repeated_rows_stays(spark):
    text = "some words that are said here more than once"
    rows = [(4, text, None, None, None)] * 5 + [(None, "other words that stand in rows without id", None, None, None)] * 3
    assert near_dedup.keep_one(documents(spark, rows)).count() == 2


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    got = connected_components(spark.createDataFrame(path + star + [(5, 5), (3, 2)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_stars_pair_members_with_their_centre_if_sizes_allow(spark):
    last = 2**63 - 1
    members = [(1, 5, 100), (1, last, 100), (1, 9, 79), (1, 7, 126), (2, last, 100), (2, 5, 100), (3, last, 100), (3, -(2**63), 80), (4, 1, 3)]
    got = near_dedup._star_pairs(spark.createDataFrame(members, "bucket long, id long, size long"), 80).collect()
    assert sorted((r.a, r.b) for r in got) == [(-(2**63), last), (5, last)]  # the fullest is the centre, of equal ones the least id


def test_signature_estimates_similarity():
    draw = np.random.RandomState(5)
    values = near_dedup._mixed(draw.randint(0, 2**62, 1200).astype(np.uint64))
    for share in (200, 500, 800):
        a, b = np.unique(values[:1000]), np.unique(values[1000 - share : 2000 - share])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - exact) < 0.12


def test_shingles_of_cut_up_signature(monkeypatch):
    values = near_dedup.shingle_set(" ".join(f"w{i}" for i in range(500)))
    whole = near_dedup.signature(values)
    monkeypatch.setattr(near_dedup, "RUN", 7)
    assert (near_dedup.signature(values) == whole).all()
