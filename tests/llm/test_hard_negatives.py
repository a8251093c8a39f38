"""Hard negatives against plain Python over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.parity import compare, oracle_connection

from fernweave.llm import hard_negatives, queries

SCHEMA = "vec_id bigint, label int, embedding array<float>, id string, anchor string, row string, block string"


def wanted(rows: list, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> list:
    """Every pair, in plain whole numbers; repeated entries count once."""
    kept = []
    for key, label, vector, *_ in rows:
        if key is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for key, label, vector in {r for r in kept if r[0] % 100 == 0}:
        score = lambda v: sum(a * b for a, b in zip(vector, v))
        same = sorted({(-score(v), i) for i, lab, v in kept if lab == label and i != key})[:positives]
        for p, positive in same:
            hard = sorted({(-score(v), i) for i, lab, v in kept if lab != label and low * -p <= 100 * score(v) <= high * -p})[:negatives]
            out += [(key, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def vectors(seed: int, count: int, width: int, labels: int = 3) -> list:
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.choice([-0.5, -0.25, 0.0, 0.25, 0.3, 0.5]) for _ in range(width)], "x", "x", "x", "x") for i in range(count)]


def mined(spark, rows: list, **sizes) -> list:
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, **sizes)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (33, 70, 129), (64, 64, 64), (100, 1, 100), (130, 37, 257)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    draw = np.random.RandomState(n)
    a, b = draw.randint(-(1 << 40), 1 << 40, (n, k)), draw.randint(-(1 << 15), 1 << 15, (k, m))
    for leaf in (1, 4, 32):
        assert (hard_negatives.strassen(a, b, leaf) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


def test_strassen_halves():
    """The recursion is used: a leaf of one multiplies single numbers only."""
    calls = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            calls.append(self.shape)
            return np.asarray(self) @ np.asarray(other)

    hard_negatives._halves(np.ones((8, 8), np.int64).view(Counted), np.ones((8, 8), np.int64).view(Counted), 3)
    assert calls == [(1, 1)] * 343


def test_against_all_pairs(spark, monkeypatch):
    """Ties abound; small cells and tiles, so that heaps are merged within and between cells."""
    rows = vectors(7, 420, 6)
    expected = wanted(rows)
    assert expected
    assert mined(spark, rows) == expected
    monkeypatch.setattr(hard_negatives, "CELL_BYTES", 8 * 6 * 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    assert mined(spark, rows) == expected
    assert mined(spark, rows, positives=2, negatives=3, low=10, high=80) == wanted(rows, 2, 3, 10, 80)


def test_odd_rows(spark):
    """NULLs, non-finite and empty vectors, repeated rows, one id with several contents, unequal lengths."""
    nan, inf = float("nan"), float("inf")
    rest = ("x",) * 4
    rows = vectors(3, 210, 4) + vectors(3, 30, 4)  # repeated rows
    rows += [(None, 1, [0.5] * 4, *rest), (300, None, [0.5] * 4, *rest), (301, 1, None, *rest), (302, 1, [0.5, None, 0.5, 0.5], *rest)]
    rows += [(303, 1, [0.5, nan, 0.5, 0.5], *rest), (400, 1, [0.5, inf, 0.5, 0.5], *rest), (304, 1, [], *rest), (305, 2, [], *rest), (500, 0, [], *rest)]
    rows += [(100, 2, [0.5, 0.5, -0.25, 0.25], *rest), (600, 1, [0.5, 0.5], *rest), (306, 0, [0.5, 0.25, 9.0, 1.0, 1.0], *rest)]
    assert mined(spark, rows) == wanted(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], "x", "x", "x", "x")]) == []


def test_query_against_sql(spark, small):
    found = queries.QUERIES["op11_hard_negatives"](spark, small)
    assert not compare(oracle_connection(small), found, queries.ORACLES["op11_hard_negatives"])


def test_plan_has_no_product(spark, small):
    found = queries.QUERIES["op11_hard_negatives"](spark, small)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
