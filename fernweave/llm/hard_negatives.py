"""Hard negatives for anchors by exact integer scores.

Anchors and candidates are dealt into blocks, and every pair of blocks meets in one cell of
bounded size.  A cell multiplies tiles of whole-number vectors by Strassen's recursion (seven
products of halves for eight), padded with zeros; additions are exact in 64-bit integers.
Each cell keeps small heaps, which are merged by anchor: first those of the positives, then,
by a second product, those of the negatives inside each positive's window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.llm.stored import small_batches, stored

#: Sides at which the recursion ends, and candidates multiplied at once.
LEAF = 32
TILE = 1024

#: Rows and bytes of vectors of either side in a cell, and cells wanted at least.
ANCHORS = 1024
CELL_BYTES = 32 << 20
CELLS = 64


def _halves(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return a @ b
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    (a1, a2), (a3, a4) = (a[:n, :k], a[:n, k:]), (a[n:, :k], a[n:, k:])
    (b1, b2), (b3, b4) = (b[:k, :m], b[:k, m:]), (b[k:, :m], b[k:, m:])
    both = _halves(a1 + a4, b1 + b4, halvings - 1)
    low = _halves(a3 + a4, b1, halvings - 1)
    right = _halves(a1, b2 - b4, halvings - 1)
    left = _halves(a4, b3 - b1, halvings - 1)
    top = _halves(a1 + a2, b4, halvings - 1)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m] = both + left - top + _halves(a2 - a4, b3 + b4, halvings - 1)
    out[:n, m:] = right + top
    out[n:, :m] = low + left
    out[n:, m:] = both - low + right + _halves(a3 - a1, b1 + b2, halvings - 1)
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices of any shape, exact modulo 2^64."""
    halvings = 0
    while min(*a.shape, b.shape[1]) >> halvings > leaf:
        halvings += 1
    padded = (np.pad(x, [(0, -side % (1 << halvings)) for side in x.shape]) for x in (a, b))
    return _halves(*padded, halvings)[: a.shape[0], : b.shape[1]]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, short ones filled up with zeros."""
    lists = pa.concat_arrays(vectors.chunks)
    ends = lists.offsets.to_numpy()
    values, lengths = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)] = values
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _ranked(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, highest scores first and least ids first among equals; ids come in order."""
    order = np.argsort(~scores, kind="stable")
    scores, ids = scores[order], ids[order]
    if len(scores):
        new = np.append(True, (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1]))
        scores, ids = scores[new], ids[new]
    return scores, ids


def _merge(heaps: dict, key: tuple, scores: np.ndarray, ids: np.ndarray, most: int) -> None:
    """Merge ranked pairs into the heap of a key, which holds the ``most`` best of distinct ones."""
    if len(scores):
        heaps[key] = sorted({*heaps.get(key, ()), *zip((~scores[:most]).tolist(), ids[:most].tolist())})[:most]


def _tiles(anchors: pa.Table, candidates: pa.Table):
    """Scores of all anchors against each tile of candidates, these by ascending id."""
    if not anchors.num_rows or not candidates.num_rows:
        return
    widths = [pa.compute.max(pa.compute.list_value_length(t["vector"])).as_py() for t in (anchors, candidates)]
    width = max(1, *widths)
    left = _matrix(anchors["vector"], width)
    ids, labels, right = _numbers(candidates, "id"), _numbers(candidates, "label"), _matrix(candidates["vector"], width)
    for at in range(0, len(ids), TILE):
        order = at + np.argsort(ids[at : at + TILE], kind="stable")
        yield strassen(left, right[order].T), ids[order], labels[order]


POSITIVE = pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([*POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _rows(heaps: dict, schema: pa.Schema) -> pa.Table:
    """One row for each entry (~score, id) of the heaps."""
    found = [(*key, i, ~s) for key, heap in heaps.items() for s, i in heap]
    return pa.table([pa.array(column, pa.int64()) for column in zip(*found)] if found else [[] for _ in schema], schema=schema)


def _positive_heaps(most: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict = {}
        keys = list(zip(*(_numbers(anchors, c).tolist() for c in ("anchor", "id", "label"))))
        for scores, ids, labels in _tiles(anchors, candidates):
            for row, (anchor, own, label) in enumerate(keys):
                same = np.flatnonzero((labels == label) & (ids != own))
                _merge(heaps, (anchor,), *_ranked(scores[row, same], ids[same]), most)
        return _rows(heaps, POSITIVE)

    return cell


def _window_heaps(most: int, low: int, high: int):
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict = {}
        keys = list(zip(_numbers(anchors, "anchor").tolist(), _numbers(anchors, "label").tolist(), anchors["positives"].to_pylist()))
        for scores, ids, labels in _tiles(anchors, candidates):
            for row, (anchor, label, positives) in enumerate(keys):
                other = np.flatnonzero(labels != label)
                ranked, named = _ranked(scores[row, other], ids[other])
                falling = ~ranked
                for p in positives:
                    best = p["positive_score"]
                    least, greatest = -(-low * best // 100), high * best // 100
                    start, stop = np.searchsorted(falling, np.int64(~greatest)), np.searchsorted(falling, np.int64(~least), "right")
                    _merge(heaps, (anchor, p["positive_id"], best), ranked[start:stop], named[start:stop], most)
        return _rows(heaps, NEGATIVE)

    return cell


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} bigint" for field in schema)


def _best(heaps: DataFrame, keys: list[str], score: str, key: str, most: int) -> DataFrame:
    """The ``most`` best of distinct entries of each key, with their rank."""
    ordered = Window.partitionBy(*keys).orderBy(F.desc(score), key)
    return heaps.withColumn("rank", F.dense_rank().over(ordered)).where(F.col("rank") <= most).distinct()


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is the integer inner product with the
    anchor, higher first, ties by id.  The positives of a row that ``anchors`` marks are its
    first ``positives`` others of one label; each gets the first ``negatives`` rows of other
    labels whose score is at least ``low`` and at most ``high`` percent of the positive's.

    Ids and labels are whole numbers.  Rows without id, label or vector, or with a NULL or
    non-finite component, take no part; a NULL mark is no anchor.  Shorter vectors count as
    filled up with zeros.  Rows with one id are never each other's positives, and entries with
    one id and one score count once, so repeated rows change nothing; rows with one id but
    other contents are each an anchor.  Scores are exact while they fit 64 bits.  Anchors
    without positives, positives with an empty window and empty tables give no rows; other
    columns are not carried.
    """
    small_batches(rows.sparkSession)
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    chosen = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.when(finite, whole).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("marked")
    )
    kept = stored(chosen.dropna(subset=["id", "label", "vector"]), "vectors")
    marked = stored(kept.where("marked").drop("marked").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    total, width, few = kept.agg(F.count("*"), F.max(F.size("vector")), F.count_if("marked")).first()

    most = max(1, CELL_BYTES // (8 * max(1, width or 1)))
    blocks = max(1, -(-few // min(ANCHORS, most)))
    cells = max(1, -(-total // min(max(TILE, total // CELLS), most)))
    each = lambda row, n: F.pmod(F.xxhash64(row), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = kept.drop("marked").withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("cell", each("row", cells)).withColumn("block", all_of(blocks)).drop("row").groupBy("block", "cell")

    def met(side: DataFrame, heaps, schema: pa.Schema) -> DataFrame:
        placed = side.withColumn("block", each("anchor", blocks)).withColumn("cell", all_of(cells))
        return placed.groupBy("block", "cell").cogroup(dealt).applyInArrow(heaps, _schema(schema))

    first = _best(met(marked, _positive_heaps(positives), POSITIVE), ["anchor"], "positive_score", "positive_id", positives)
    wanted = stored(first.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    sides = stored(marked.join(wanted, "anchor"), "anchors-with-positives")
    found = _best(met(sides, _window_heaps(negatives, low, high), NEGATIVE), list(POSITIVE.names), "negative_score", "negative_id", negatives)
    named = found.join(sides.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
