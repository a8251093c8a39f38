"""Line rules of the quality operator: the SQL twin on lines that only they decide, and wrapped prose."""

from __future__ import annotations

import random
import textwrap

import duckdb
import pytest
from tests.llm.conftest import documents
from tests.parity import compare

from fernweave.llm import quality, queries

PARAGRAPH = (
    "The harbour of the old town was built by merchants who had sailed from the north with timber and wool, and who wanted a safe place for their ships. "
    "Every spring the fishermen mended their nets along the quay while children ran between the barrels and the gulls cried over the roofs of the market. "
    "A narrow street led uphill to the church, where the bell rang twice a day and the baker opened his shop before anyone else was awake. "
    "When the war came most of the houses were lost, yet the families returned and built them again from the same grey stone as before."
)
PIECES = [
    "a line of quite some words that nobody ever closed", "Home", "About us", "Our shop", "One two three four five six seven eight.", "a / b / c / d", "Start > Shop > Cart",
    "x # y * z & w", "### *** ### ***", "it it it it it it", "All rights reserved 2020", "“He said so.” and went", "", "  ", "\t", "word\r", "what now?\t", "a | b | c | d", "ok: see (this).",
    "the quick brown fox jumps over the lazy dog and then", "it stops.", "Straße über Flüsse und Berge im Süden des Landes ohne", "终于。", "end ...", "· · ·", "1 > 0", "» next «",
]


@pytest.mark.parametrize("width", [40, 60, 72, 100])
def test_wrapped_prose_loses_nothing(spark, width):
    text = "\n\n".join(["\n".join(textwrap.wrap(PARAGRAPH, width))] * 1)
    (row,) = quality.clean(documents(spark, [(1, text, "en", "a", 1)])).collect()
    assert row.kept and row.n_lost_words == 0 and row.clean_text == text


def test_wrapped_and_whole_paragraphs_have_one_verdict(spark):
    (whole,) = quality.clean(documents(spark, [(1, PARAGRAPH, "en", "a", 1)])).collect()
    (wrapped,) = quality.clean(documents(spark, [(1, "\r\n".join(textwrap.wrap(PARAGRAPH, 72)), "en", "a", 1)])).collect()
    assert (whole.kept, whole.n_lost_words) == (wrapped.kept, wrapped.n_lost_words) == (True, 0)


def test_unclosed_lines_beside_prose_still_fail(spark):
    junk = "Home Products Services Prices Contact Careers Login Newsletter"
    for text in (f"{junk}\n{PARAGRAPH}", f"{PARAGRAPH}\n{junk}", f"{PARAGRAPH}\n\n{junk}\n\n{PARAGRAPH} It goes on."):
        (row,) = quality.clean(documents(spark, [(1, text, "en", "a", 1)])).collect()
        assert row.n_lost_words == 8 and junk not in row.clean_text
    (row,) = quality.clean(documents(spark, [(1, "\n".join(f"some line number {i} of a list that is never closed at all" for i in range(9)), "en", "a", 1)])).collect()
    assert not row.kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_twin_has_all_line_rules(spark, tmp_path, seed):
    draw = random.Random(seed)
    texts = ["\n".join(draw.choice(PIECES) for _ in range(draw.randint(1, 14))) for _ in range(150)]
    texts += ["\n".join(textwrap.wrap(PARAGRAPH, w)) + draw.choice(["", "\n", "\nno end here but a good many words follow on"]) for w in range(30, 130, 7)]
    documents(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = queries.op10_quality(spark, str(tmp_path))
    assert not compare(con, found, queries.ORACLES["op10_quality"])
    assert found.where("n_lost_words > 0").count() > 50
