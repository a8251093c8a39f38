"""Relationships by shared values: sketches rule out pairs, never one that counts."""

from __future__ import annotations

import pytest

from fernweave.operators import semantics
from fernweave.operators.semantics import column_keys, discover_overlap, discover_overlap_sketched, overlap_candidates


@pytest.fixture(scope="module")
def catalog(spark):
    """Tables whose columns hold a stated share of the numbers 0 to 19 999 or lie beside them."""
    shares = {"whole": 100, "half": 50, "just": 30, "below": 29, "little": 5, "none": 0}
    frames = {"keys": spark.range(20_000).withColumnRenamed("id", "k")}
    for name, share in shares.items():
        frames[name] = spark.range(20_000).selectExpr(f"if(id < 200 * {share}, id, id + 1000000) AS r", "if(id % 9 = 0, NULL, id % 7) AS few")
    frames["few"] = spark.createDataFrame([(1,), (2,), (None,), (900_000,), (900_000,)], "r long")
    frames["nothing"] = spark.createDataFrame([], "r long")
    references = [(n, "r") for n in [*shares, "few", "nothing"]] + [(n, "few") for n in shares]
    return frames, references, [("keys", "k"), ("whole", "r"), ("nothing", "r")]


def rows(df):
    return sorted(map(tuple, df.select("left_table", "left_column", "right_table", "right_column", "overlap_count", "overlap_ratio", "confidence", "sample_matches").collect()))


@pytest.mark.parametrize("sketch", [500, 4096, 50_000])
def test_sketched_rows_are_those_of_the_plain_form(catalog, sketch):
    plain, found = discover_overlap(*catalog), discover_overlap_sketched(*catalog, sketch=sketch)
    assert rows(found) == rows(plain)
    assert ("keys", "k", "just", "r") in {r[:4] for r in rows(found)} and ("keys", "k", "below", "r") not in {r[:4] for r in rows(found)}


def test_pairs_compared_in_full_are_few(catalog):
    frames, references, keys = catalog
    fk, pk = semantics._side(column_keys(frames, references), "right"), semantics._side(column_keys(frames, keys), "left")
    found = {(r["left_table"], r["right_table"], r["right_column"]): r for r in overlap_candidates(fk, pk, sketch=4096).collect()}
    assert ("keys", "little", "r") not in found and ("keys", "none", "r") not in found
    assert all(("keys", n, "r") in found for n in ("whole", "half", "just", "few"))
    assert found["keys", "few", "r"]["exact"] and found["keys", "few", "r"]["sampled"] == 3
    assert not found["keys", "half", "r"]["exact"] and abs(found["keys", "half", "r"]["sampled"] - 4096) < 400


def test_shares_too_small_for_sketches_are_counted_in_full(catalog):
    assert rows(discover_overlap_sketched(*catalog, min_ratio=0.02, sketch=500)) == rows(discover_overlap(*catalog, min_ratio=0.02))
