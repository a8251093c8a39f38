"""Group documents whose SimHash fingerprints differ in a few bits: meet in the middle.

Every fingerprint has all variants within half the radius; two fingerprints are links exactly
if they have a variant in common, the one halfway between.  Variants are shuffled by their
first bits: a fingerprint goes once to each group that holds variants of it, and the rest of
each variant is made inside the group, in slices of bounded size.  Groups that are still too
large send their variants one by one.

All fingerprints with one variant are links of each other (each is within half the radius of
it), so the least of them stands for the rest: no link is lost and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.components import connected_components
from fernweave.llm.stored import sent_if_few, small_batches, stored

#: Words in a shingle, and bits in which links may differ.
SHINGLE = 4
RADIUS = 4

BITS = 64

#: First bits of a group at least and at most; fingerprints wanted in a group, and those it may have.
LEAST_PREFIX, MOST_PREFIX = 8, 32
WANTED = 100_000
MOST = 1_000_000

#: Variants made at once, and hashes whose bits are counted at once.
SLICE = 1 << 22
RUN = 1 << 15

#: The seed that Spark's own ``xxhash64`` has.
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, words: int = SHINGLE) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half the hashes of its shingles, repeats included."""
    tokens = text.translate(_LOWER).split() if text else []
    if not tokens:
        return 0
    joined, hashed = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hashed(joined, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - words or None], ends[words - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), RUN):
        run = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + RUN].tolist(), ends[at : at + RUN].tolist())], ">u8")
        counts += np.add.reduce(np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprint_column(text: Column | str, words: int = SHINGLE) -> Column:
    """The fingerprint of each whole text as a signed number; zero for NULL and blank texts."""

    @F.arrow_udf("bigint")
    def sketch(texts: pa.Array) -> pa.Array:
        made = [fingerprint(t.as_py(), words) for t in texts.cast(pa.binary())]
        return pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())

    return sketch(text)


def as_hex(value: Column | str) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


@lru_cache
def _masks(bits: int, flips: int) -> np.ndarray:
    """All masks of at most so many set bits."""
    flips = min(bits, flips)
    return np.array([sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(bits), n)], np.uint64)


def _ball(bits: int, flips: int) -> int:
    return sum(comb(bits, n) for n in range(flips + 1))


def _meetings(values: np.ndarray, flips: np.ndarray, owners: np.ndarray, bits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the least owner of a shared variant and each other one.

    ``values`` have ``bits`` bits, of which ``flips`` may still be changed.  What has too many
    variants is halved by their first bit.
    """
    counts = np.bincount(flips)
    if sum(int(n) * _ball(bits, f) for f, n in enumerate(counts)) > most and bits:
        own = values >> np.uint64(bits - 1)
        rest = values & np.uint64((1 << (bits - 1)) - 1)
        for side in (0, 1):
            left = flips - (own != side)
            here = left >= 0
            if here.sum() > 1:
                yield from _meetings(rest[here], left[here], owners[here], bits - 1, most)
        return
    parts = [(values[flips == f], owners[flips == f], _masks(bits, f)) for f in np.flatnonzero(counts)]
    variants = np.concatenate([(v[:, None] ^ masks[None, :]).ravel() for v, _, masks in parts])
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return
    holders = np.concatenate([np.repeat(o, len(masks)) for _, o, masks in parts])
    place = np.searchsorted(shared, variants)
    hit = shared[np.minimum(place, len(shared) - 1)] == variants
    place, holders = place[hit], holders[hit]
    least = np.full(len(shared), np.iinfo(np.int64).max)
    np.minimum.at(least, place, holders)
    other = least[place] != holders
    yield least[place][other], holders[other]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Places of links that join what the links before have not joined."""
    parent, used = list(range(n)), []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(at)
    return used


def group_links(fingerprints: np.ndarray, group: int, prefix: int, radius: int = RADIUS, most: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that have variants beginning with the ``prefix`` bits of ``group``; others are left out.

    Enough links are given to connect all that the group's variants connect.
    """
    values = np.unique(fingerprints)
    rest = BITS - prefix
    flips = radius // 2 - np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(group)).astype(np.int64)
    values, flips = values[flips >= 0], flips[flips >= 0]
    low = values & np.uint64((1 << rest) - 1)
    n, known = len(values), np.empty(0, np.int64)
    for a, b in _meetings(low, flips, np.arange(n), rest, most):
        known = np.union1d(known, a * n + b)
    a, b = known // n, known % n
    close = np.bitwise_count(values[a] ^ values[b]) <= radius
    a, b = a[close], b[close]
    used = _forest(a, b, n)
    return values[a[used]], values[b[used]]


def _prefix_bits(count: int, half: int, wanted: int) -> int:
    bits = LEAST_PREFIX
    while bits < MOST_PREFIX and count * _ball(bits, half) >> bits > wanted:
        bits += 1
    return bits


def _literals(masks: np.ndarray) -> Column:
    return F.lit(masks.view(np.int64).tolist())


def fingerprint_links(found: DataFrame, radius: int = RADIUS, wanted: int = WANTED, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits.

    All links can be reached by those given.  ``radius`` is even.  Groups of more than ``most``
    fingerprints are not brought together: their variants are shuffled one by one.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even, so that all who share a variant are links")
    half = radius // 2
    bits = _prefix_bits(found.count(), half, wanted)
    rest = BITS - bits
    near = F.explode(_literals(_masks(bits, half)))
    first = F.shiftrightunsigned("fp", rest)
    sizes = found.groupBy(first.alias("own")).count().select(F.col("own"), "count", near.alias("mask"))
    large = stored(sizes.groupBy(F.col("own").bitwiseXOR(F.col("mask")).alias("grp")).agg(F.sum("count").alias("n")).where(F.col("n") > most).select("grp"), "large-groups")
    spread = found.select("fp", near.alias("mask")).select(first.bitwiseXOR(F.col("mask")).alias("grp"), "fp")

    def meet(members: pa.Table) -> pa.Table:
        a, b = group_links(members["fp"].to_numpy().view(np.uint64), members["grp"][0].as_py(), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = spread.join(sent_if_few(large), "grp", "left_anti").groupBy("grp").applyInArrow(meet, "a bigint, b bigint")
    if not large.isEmpty():
        used = F.bit_count(first.bitwiseXOR(F.col("grp")))
        changes = F.lit(None)
        for n in range(half + 1):
            changes = F.when(used == n, _literals(_masks(rest, half - n))).otherwise(changes)
        low = F.col("fp").bitwiseAND(F.lit((1 << rest) - 1))
        whole = F.shiftleft("grp", rest).bitwiseOR(low).bitwiseXOR(F.col("mask"))
        variants = stored(spread.join(sent_if_few(large), "grp").select("grp", "fp", F.explode(changes).alias("mask")).select(whole.alias("variant"), "fp"), "variants")
        least = stored(variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("variant", "a"), "least-of-variants")
        met = variants.join(least, "variant").where("a <> fp").select("a", F.col("fp").alias("b"))
        links = links.union(met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Component of each document: (id, fingerprint, component_id), one row for each row.

    Fingerprints that differ in at most ``radius`` bits (an even number) are links; a
    component is what links connect, named by its least id.  NULL and blank texts have the
    fingerprint zero and are linked like any other; a text of fewer than ``words`` words is
    one shingle.  Ids are whole numbers; rows with one id keep their own fingerprints, and a
    row without id goes with the component of its fingerprint, which is NULL if it has no id
    at all.  An empty table gives an empty result; other columns are not carried.
    """
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).cast("bigint").alias("id"), fingerprint_column(F.col(text_col), words).alias("fp")), "fingerprints")
    sets = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    linked = stored(connected_components(fingerprint_links(sets, radius)), "components").withColumnRenamed("node", "fp")
    names = linked.join(sets, "fp").groupBy("component").agg(F.min("least").alias("name"))
    named = sets.join(linked.join(names, "component").select("fp", "name", F.lit(True).alias("linked")), "fp", "left")
    named = stored(named.select("fp", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")), "named")
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
