"""Group near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

A signature takes two permutations of a fixed universe.  The first places a shingle; the
second, shifted by one place for each coordinate, gives that coordinate's order, so that a
shingle's values in all coordinates lie side by side and are read in one piece.

Equal shingle sets are folded to their least id first, so copies cost one group-by however
many there are.  Then every band bucket is a star: its members are compared with one centre
only.  Documents of buckets that still hold several components (a common passage or unlike
edits of one text bring them together) go through an exact prefix filter: only pairs of
different components that share one of their rarest shingles early enough are compared.
All links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.components import connected_components
from fernweave.llm.stored import sent_if_few, small_batches, stored

#: Words in a shingle and the least similarity, in percent.
SHINGLE = 5
SIMILARITY = 80

#: Bands and coordinates in each: at similarity 0.8 a pair is missed with probability 3e-6.
BANDS = 42
ROWS = 6

#: Places of the permutations' universe, and shingles looked up at once.
UNIVERSE = 1 << 20
RUN = 4096

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache
def _factors(n: int) -> np.ndarray:
    """Odd factors that tell places in a run apart."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


@lru_cache
def _permutations(universe: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first permutation; the second one, as the row of its shifted values at each place."""
    draw = np.random.RandomState(20_240_229)
    first, second = draw.permutation(universe).astype(np.uint32), draw.permutation(universe).astype(np.uint32)
    ring = np.concatenate([second, second[: coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case.

    A text with fewer words is one shingle; NULL and blank texts have none.
    """
    tokens = text.encode().translate(_LOWER).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    known: dict[bytes, int] = {}
    hashes = np.fromiter((known.get(t) or known.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens), np.uint64, len(tokens))
    factors, total = _factors(words), np.zeros(len(tokens) - words + 1, np.uint64)
    for k in range(words):
        total += hashes[k : k + len(total)] * factors[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signature of a shingle set."""
    first, second = _permutations(UNIVERSE, coordinates)
    places = np.unique(first[(shingles >> np.uint64(44)).astype(np.int64) % UNIVERSE])
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), RUN):
        np.minimum(least, second[places[at : at + RUN]].min(axis=0), out=least)
    return least


def band_hashes(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of a signature."""
    bands = least.reshape(-1, rows).astype(np.uint64)
    return _mixed(_mixed((bands * _factors(rows)).sum(axis=1, dtype=np.uint64)) + _factors(len(bands))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


SKETCHED = "struct<n_shingles: bigint, same: binary, bands: array<bigint>>"


def _sketched(text: Column, words: int) -> Column:
    kind = pa.struct([("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf(SKETCHED)
    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            shingles = shingle_set(value.as_py(), words)
            if len(shingles):
                rows.append((len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), band_hashes(signature(shingles))))
            else:
                rows.append((0, None, None))
        counts, same, bands = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], fields=list(kind))

    return sketch(text)


def _confirmed(a: Column, b: Column, words: int, percent: int) -> Column:
    @F.arrow_udf("boolean")
    def confirm(left: pa.Array, right: pa.Array) -> pa.Array:
        known = lru_cache(256)(lambda text: shingle_set(text, words))  # stars bring the same text many times
        return pa.array((similar(known(x.as_py()), known(y.as_py()), percent) for x, y in zip(left, right)), pa.bool_())

    return confirm(a, b)


def _links(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough.

    Only texts that occur in a pair are moved, and they are stored in between, so that both
    joins have plain shuffles on either side and a text with very many pairs can be split.
    The text of ``a`` is joined first and travels with its pairs; that of ``b``, which may be
    the centre of very many, is met where it lies.
    """
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stored(docs.join(sent_if_few(stored(ids, "pair-ids")), "id", "left_semi"), "pair-texts")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    checked = both.select("a", "b", _confirmed(F.col("left"), F.col("right"), words, percent).alias("linked"))
    return stored(checked.where("linked").select("a", "b").distinct(), "confirmed")


def _with_component(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (bucket, id) with the component of their id."""
    found = stored(connected_components(links), "components").withColumnRenamed("node", "id")
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _shingles_of(docs: DataFrame, words: int) -> DataFrame:
    """One row for each distinct shingle of each document: (id, shingle, size)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                found = shingle_set(text.as_py(), words)
                for at in range(0, len(found), 1 << 16):
                    run = found[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(run), key.as_py(), np.int64)), pa.array(run), pa.array(np.full(len(run), len(found), np.int64))], names=["id", "shingle", "size"]
                    )

    return docs.select("id", "text").mapInArrow(spread, "id bigint, shingle bigint, size bigint")


def _prefixes(ids: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rarest shingles of each document with their places in its order: (shingle, id, place, size).

    Of two sets similar enough, the rarest ``size - ceil(size * similarity) + 1`` shingles of
    either must meet.  A passage that many texts share is not among the rarest of any.
    """
    rows = stored(_shingles_of(docs.join(sent_if_few(ids), "id", "left_semi"), words), "open-shingles")
    counts = stored(rows.groupBy("shingle").count(), "shingle-counts")  # so that the join has plain shuffles and a hot shingle can be split
    ranked = rows.join(counts, "shingle").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("all"))
    kept = F.expr(f"cast(size - ceil(size * {percent} / 100) + 1 as int)")
    placed = ranked.select("id", "size", F.posexplode(F.slice("all", F.lit(1), kept)).alias("place", "rare"))
    return placed.where("rare.count > 1").select(F.col("rare.shingle").alias("shingle"), "id", "place", "size")


def _open_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be similar enough, from (shingle, id, place, size, component).

    The first shingle that both have bounds what can follow it in either order; pairs that
    cannot reach the wanted overlap even so are never made.
    """
    here, there = (prefixes.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "place", "size", "component"))) for side in "ab")
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = left * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent
    met = here.join(there, (here["shingle"] == there["shingle"]) & (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & enough)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket (a) with the bucket's centre (b), if their sizes allow the similarity.

    The centre is the member whose buckets are the fullest in all, the least id on ties: what
    others were copied from shares more buckets with each of them than they do among
    themselves, so one star usually holds the whole family.
    """
    sizes = stored(members.groupBy("bucket").count().where("count > 1"), "bucket-sizes")
    shared = stored(members.join(sent_if_few(sizes), "bucket"), "shared")
    weights = stored(shared.groupBy("id").agg(F.sum("count").alias("weight"), F.min("size").alias("low"), F.max("size").alias("high")), "weights")
    weighed = shared.join(sent_if_few(weights), "id")
    fullest = F.max_by(F.struct(F.col("id").alias("centre"), "low", "high"), F.struct("weight", F.bitwise_not("id").alias("i")))
    centres = stored(weighed.groupBy("bucket").agg(fullest.alias("c")).select("bucket", "c.*"), "centres")
    pairs = shared.join(sent_if_few(centres), "bucket").where(f"centre <> id and 100 * size >= {percent} * low and 100 * high >= {percent} * size")
    once = pairs.groupBy(F.least("centre", "id").alias("x"), F.greatest("centre", "id").alias("y")).agg(F.max("centre").alias("b"))
    return once.select(F.when(F.col("x") == F.col("b"), F.col("y")).otherwise(F.col("x")).alias("a"), "b")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) for each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = stored(texts.select("id", F.xxhash64("text").alias("text_hash"), _sketched(F.col("text"), words).alias("s")).select("id", "text_hash", "s.*"), "signatures")
    sets = stored(rows.where("same is not null").groupBy("same").agg(F.min("id").alias("least")), "sets")
    chosen = rows.where("id is not null").join(sets, "same").where("id = least").dropDuplicates(["same", "id"])
    spread = chosen.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    several = stored(spread.groupBy("bucket").count().where("count > 1").select("bucket"), "shared-buckets")
    members = stored(spread.join(sent_if_few(several), "bucket").select("bucket", "id", "size"), "members")
    links = _links(_star_pairs(members, percent), texts, words, percent)

    placed = stored(_with_component(members, links), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    open_ids = stored(placed.join(sent_if_few(stored(mixed, "mixed-buckets")), "bucket").select("id", "component").distinct(), "open-ids")
    prefixes = stored(_prefixes(open_ids.select("id"), texts, words, percent).join(sent_if_few(open_ids), "id"), "prefixes")
    links = links.union(_links(_open_pairs(prefixes, percent), texts, words, percent))

    found = stored(connected_components(links), "components").withColumnRenamed("node", "least")
    named = stored(sets.join(found, "least", "left").select("same", F.coalesce("component", "least").alias("component_id")), "named")
    out = rows.select("id", "text_hash", "n_shingles", "same").join(named, "same", "left")
    out = out.withColumn("component_id", F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("id", "text_hash", "n_shingles", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """Component of each document: (id, n_shingles, component_id, kept).

    Documents with ``percent`` or more of their shingles in common are linked; a component is
    what links connect, named by its least id, and ``kept`` marks that document.  NULL and
    blank texts have no shingles and are their own component.  Ids are whole numbers.  Rows
    with one id are told apart by their texts; where such an id is the least of several
    groups, these are joined.  A row without id goes with the group of its text and is not
    kept if a document with an id has the same text; otherwise its component is NULL and it
    is kept.  An empty table gives an empty result; other columns are not carried.
    """
    found = _verdicts(docs, id_col, text_col, words, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each group, all columns as they were.

    Of rows that share the group's least id, and of rows without id and with one text, one
    stays.  NULL and blank texts are in no group and all stay.
    """
    found = stored(_verdicts(docs, id_col, text_col, words, percent), "verdicts")
    group = F.coalesce("component_id", "text_hash")
    judged = found.select(F.col("id").alias("__fw_id"), F.col("text_hash").alias("__fw_hash"), "kept", F.when(F.col("n_shingles") > 0, F.struct("component_id", group.alias("g"))).alias("__fw_group"))
    gone = judged.where("not kept").select("__fw_id", "__fw_hash")
    several = judged.where("kept and __fw_group is not null").groupBy("__fw_group").count().where("count > 1").select("__fw_group")
    repeated = judged.where("kept").join(stored(several, "repeated-groups"), "__fw_group").select("__fw_id", "__fw_hash", "__fw_group").distinct()
    repeated = stored(repeated, "repeated")
    away = stored(gone.union(repeated.select("__fw_id", "__fw_hash")).distinct(), "away")
    same_row = F.expr("d.`__fw_key` <=> a.`__fw_id` and d.`__fw_text` = a.`__fw_hash`")
    keyed = docs.withColumns({"__fw_key": F.col(id_col).cast("bigint"), "__fw_text": F.xxhash64(text_col)}).alias("d")
    rest = keyed.join(sent_if_few(away).alias("a"), same_row, "left_anti").select(*(f"d.`{c}`" for c in docs.columns))
    if repeated.isEmpty():
        return rest
    firsts = keyed.join(sent_if_few(repeated).alias("a"), same_row).dropDuplicates(["__fw_group"])
    return rest.unionByName(firsts.select(*(f"d.`{c}`" for c in docs.columns)))
