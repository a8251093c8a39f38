"""Mixing, sharding, quality rules and sketches: plain Python, SQL, and rows of any kind."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, documents
from tests.parity import compare, oracle_connection

from fernweave.llm import mixing, quality, queries, sharding, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLES if not n.startswith("op8")))
def test_query_against_sql(spark, small, name):
    assert compare(oracle_connection(small), queries.QUERIES[name](spark, small), queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op3_mixing", "op6_fingerprints", "op9_sharding", "op10_quality"])
def test_native_queries_run_no_python(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# mixing


def targets(sizes: dict) -> dict:
    """Share and reshare, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        level = (budget - sum(capped.values())) / (sum(weight[s] for s in open_) or 1)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        capped |= {s: 2.0 * sizes[s] for s in over}


def mixed(rows: list, result) -> None:
    got = [r.asDict() for r in result.collect()]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(sizes)
    assert Counter((r["size"], r["source_size"]) for r in got) == Counter((len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert {round(r["target"], 6) for r in got} == {round(want[r[3]], 6) for r in rows}


def test_mixing_rows_of_any_kind(spark, odd, empty):
    mixed(ODD, mixing.mix(odd))
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    taken = mixing.take(odd)
    assert taken.columns == odd.columns


def test_mix_comes_near_its_targets_and_is_the_same_again(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    by_source = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.03 * r.target for r in by_source)
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(5)).collect())
    copies = mixing.take(docs).groupBy("doc_id").count().collect()
    size = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    assert all(r["count"] * size[r.doc_id][1] == size[r.doc_id][0] for r in copies if size[r.doc_id][1])


def test_hot_source_and_equal_keys(spark):
    rows = [(i % 7 if i % 3 == 0 else i, "w " * (1 + i % 5), "en", "hot" if i % 3 else f"s{i % 4}", 0) for i in range(600)]
    mixed(rows, mixing.mix(documents(spark, rows)))


def test_weights_must_make_sense(odd):
    with pytest.raises(ValueError):
        mixing.mix(odd, weights=(1.0, 0.0))


# sharding


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    seven = {r.doc_id: r.shard for r in sharding.assign_shards(rows, [1.0] * 7).collect()}
    eight = {r.doc_id: (r.shard, r.grown) for r in sharding.assign_shards(rows, [1.0] * 8, grown_col="grown").collect()}
    assert all(eight[k][0] in (7, s) for k, s in seven.items())
    assert {r.doc_id: r.grown for r in sharding.assign_shards(rows, [1.0] * 7, grown_col="grown").collect()} == {k: v[0] for k, v in eight.items()}
    moved = sum(eight[k][0] == 7 for k in seven)
    assert 400 < moved < 600


def test_shards_follow_their_weights(spark):
    rows = spark.range(8000).withColumnRenamed("id", "doc_id")
    counts = {r.shard: r["count"] for r in sharding.assign_shards(rows, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert [round(counts[i] / 1000) for i in range(3)] == [1, 2, 5]
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, [1.0, -1.0])


def test_slots_have_no_gaps(spark, odd, empty):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 5, id) as doc_id", "id % 4 as shard")
    for r in sharding.number_rows(rows, "shard", "doc_id", ["doc_id"]).groupBy("shard").agg(F.collect_list("slot").alias("s")).collect():
        assert sorted(r.s) == list(range(len(r.s)))
    placed = sharding.assign_shards(odd, [1.0] * 3)
    numbered = sharding.number_rows(placed, "shard", "doc_id", ["doc_id", "text"]).collect()
    assert len(numbered) == len(ODD)
    by_shard = defaultdict(list)
    for r in numbered:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.assign_shards(empty, [1.0]).count() == 0


# quality


def counts(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "a b c d e f g h " * 3, "x " * 40, "one\ntwo\none\n \n\none", "Home | About | Contact | Imprint | Help", "buy!!! now!!! all$$$ here&&& it### is%%%",
    "go go go go go go", "Licensed under the Apache License, Version 2.0.", "é ß 漢字 \U0001f600", "#*$%&|<>", "a b c d e f g h a b c d e f g h i a b c d e f g",
]


def test_quality_counts_against_plain_python(spark, odd, empty):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)]
    for r in quality.clean(documents(spark, rows)).collect():
        want = counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    made = quality.clean(odd).collect()
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in made) == Counter(counts(r[1] or "") for r in ODD)
    assert quality.clean(empty).count() == 0


def test_failing_lines_are_removed(spark):
    good = "This is a line of the text that says what it has to say, and it ends here."
    bad = [TEXTS[3], TEXTS[4], TEXTS[5], TEXTS[6]]
    rows = [(0, "\n".join([good, *bad, good.upper()]), None, None, None), (1, "\n".join([good, *bad * 3]), None, None, None)]
    kept, lost = sorted(quality.clean(documents(spark, rows)).collect())
    assert kept.clean_text == f"{good}\n{good.upper()}" and kept.kept
    assert lost.clean_text == good and not lost.kept


def test_lines_without_punctuation_and_menus_are_removed(spark):
    good = "This is a line of the text that says what it has to say, and it ends here."
    kept = [good, f"{good}\nA heading\n{good}", "Two short\nlines", good, "he / she / they said so, and went.", "a line that stops in its midst. And then it goes on without"]
    bad = ["Home\nAbout us\nContact\nImprint", "Shop > Shoes > Boots", "home / news / sport", "# a * b $ c", "words that go on and on and never come to any end"]
    text = "\n".join(x for pair in zip(kept, [*bad, good]) for x in pair)
    (row,) = quality.clean(documents(spark, [(0, text, None, None, None)])).collect()
    lost = "\n".join(bad).split("\n")
    assert row.clean_text.split("\n") == [x for x in text.split("\n") if x not in lost]
    assert row.n_lost_words == sum(len(WORD.findall(x)) for x in lost)
    (menu,) = quality.clean(documents(spark, [(0, "\n".join(f"Link {chr(97 + i)}" for i in range(20)), None, None, None)])).collect()
    assert not menu.base_failed and not menu.kept and menu.clean_text == ""


def test_quality_agrees_with_labels(spark, small):
    folder = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op10_quality(spark, folder).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    table = {(r.quality, r.kept): r["count"] for r in got}
    assert table.get((1, False), 0) == 0 and table.get((0, True), 0) <= 0.05 * table[0, False]


# sketches


def shingles(text: str) -> set:
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("run_rows", [2048, 16])
def test_fingerprints_against_plain_python(spark, small, monkeypatch, run_rows):
    monkeypatch.setattr(sketches, "RUN_ROWS", run_rows)
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, small).collect()}
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited, r = text[: len(text) - cut] + after[:cut], got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(text, edited)) < 0.2 and abs(r.near_next - likeness(text, after)) < 0.2
        by_text[text].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_sketches_of_parts_merge(spark):
    text = " ".join(f"w{i * i % 1009}" for i in range(3000))
    words = text.split(" ")
    row = spark.createDataFrame([(text, " ".join(words[:1504]), " ".join(words[1500:]))], ["t", "a", "b"])
    whole, a, b = (sketches.sketch(F.col(c)) for c in "tab")
    r = row.select((whole == sketches.merge(a, b)).alias("same"), sketches.distinct_count(whole).alias("n"), sketches.containment(a, whole).alias("c"), sketches.containment(whole, whole).alias("w")).first()
    exact = len(shingles(text))
    assert r.same and abs(r.n - exact) < 0.3 * exact and r.c > 0.85 and r.w == 1.0


def test_sketches_of_rows_of_any_kind(spark, odd, empty):
    made = sketches.compare_edited(odd).collect()
    assert Counter(r.n_chars for r in made) == Counter(len(r[1] or "") for r in ODD)
    order = sorted(((-(2**63) if r[0] is None else r[0]), r[1] or "") for r in ODD)
    want = Counter(t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert Counter(r.edited for r in made) == want
    assert sketches.compare_edited(empty).count() == 0
    assert {r.distinct_shingles for r in sketches.fingerprints(odd).where("doc_id in (2, 3, 4)").collect()} == {0.0}
