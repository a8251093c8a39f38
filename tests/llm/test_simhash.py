"""SimHash groups against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import ODD, documents
from tests.parity import oracle_connection

from fernweave.llm import queries, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text: str | None, words: int = 4) -> int:
    tokens = (text or "").translate(LOWER).encode().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values: list[int], radius: int = 4) -> list[int]:
    """Class number of each value, from all pairs."""
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(values))]


def cloud(seed: int, families: int = 12, members: int = 30) -> list[int]:
    """Families around a few centres, with chains, and single values."""
    draw = random.Random(seed)
    values = [0, (1 << 64) - 1]
    for _ in range(families):
        value = draw.getrandbits(64)
        for _ in range(members):
            values.append(value)
            for bit in draw.sample(range(64), draw.randint(1, 7)):
                value ^= 1 << bit
    return list(dict.fromkeys(values + [draw.getrandbits(64) for _ in range(200)]))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def linked(spark, values: list[int], **sizes) -> list[int]:
    """Classes from the operator's links, which must all be true ones."""
    found = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(found, **sizes).collect()]
    assert all(0 < (a ^ b).bit_count() <= sizes.get("radius", 4) for a, b in links)
    near = {v: {v} for v in values}
    for a, b in links:
        whole = near[a] | near[b]
        for v in whole:
            near[v] = whole
    place = {v: i for i, v in enumerate(values)}
    return [min(place[w] for w in near[v]) for v in values]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed):
    values = cloud(seed)
    assert linked(spark, values) == classes(values)


@pytest.mark.parametrize("sizes", [{"most": 20}, {"wanted": 1}, {"most": 200, "wanted": 20}, {"radius": 2}, {"radius": 0}])
def test_large_groups_and_long_prefixes(spark, sizes, monkeypatch):
    """Groups over the bound send their variants one by one; others have more first bits."""
    monkeypatch.setattr(simhash, "MOST_PREFIX", 12)
    values = cloud(5, families=5)
    assert linked(spark, values, **sizes) == classes(values, sizes.get("radius", 4))


def test_small_slices_lose_nothing():
    values = np.array(cloud(9, families=4, members=60), np.uint64)
    whole = simhash.group_links(values, int(values[1] >> np.uint64(56)), 8)
    cut = simhash.group_links(values, int(values[1] >> np.uint64(56)), 8, most=500)
    assert len(whole[0]) == len(cut[0]) > 0


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp bigint"), radius=3)


@pytest.mark.parametrize("text", [r[1] for r in ODD] + ["A b", "É a B c d", "a a a a a a", "x" * 3000, "a\x0bb\x0cc\x1cd\x85e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_long_text_in_runs(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "RUN", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_odd_documents(spark, odd):
    found = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=repr)
    blank = 2  # least id of the NULL and blank texts, which have the fingerprint zero
    expected = []
    for key, text, *_ in ODD:
        f = plain_fingerprint(text)
        same = [k for k, t, *_ in ODD if k is not None and plain_fingerprint(t) == f]
        expected.append((key, signed(f), blank if f == 0 else min(same, default=None)))
    assert found == sorted(expected, key=repr)


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_query_against_all_pairs(spark):
    """The registered query on a whole table."""
    folder = "/root/testdata/sf0.01"
    rows = oracle_connection(folder).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    values = [plain_fingerprint(t) for _, t in rows]
    expected = [(key, f"{v:016x}", rows[c][0]) for (key, _), v, c in zip(rows, values, classes(values))]
    found = queries.QUERIES["op12_simhash"](spark, folder)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect())) == expected


def test_copies_meet_near_texts(spark):
    """Whole documents: a third are copies of one text, others differ from it by a few bits at most."""
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = draw.choices(words, k=900)
    texts = [" ".join(base)] * 40
    for n in range(40):
        edited = list(base)
        for _ in range(n % 8):
            edited[draw.randrange(900)] = draw.choice(words)
        texts.append(" ".join(edited))
    texts += [" ".join(draw.choices(words, k=60)) for _ in range(40)]
    values = [plain_fingerprint(t) for t in texts]
    found = simhash.near_duplicates(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(classes(values)))
