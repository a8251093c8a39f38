"""Exact trailing rates on a stream, with late rows reported instead of dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fernweave.streaming.ingest import store_updates

#: Groups of requesters; a stream that goes on from a checkpoint must keep the number.
SPREAD = 64

#: Bytes of counts that a task packs at once, rows of a packed piece of state and pieces before they are joined.
HELD_BYTES = 64 << 20
PIECE_ROWS = 1 << 18
PIECES = 16


def _packed(counts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema) as writer:
        writer.write_table(counts)
    return sink.getvalue().to_pybytes()


def _summed(counts: pa.Table) -> pa.Table:
    """(who, second, n), one row for each requester and second."""
    return counts.group_by(["who", "second"]).aggregate([("n", "sum")]).select(["who", "second", "n_sum"]).rename_columns(["who", "second", "n"])


def _unpacked(pieces: list[bytes]) -> pa.Table:
    return _summed(pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in pieces]))


class _Trailing(StatefulProcessor):
    """Counts per second of a group of requesters in one window-long bucket, and in the bucket before it.

    A second is closed once the watermark has passed its end; a timer then reports it, and
    the last timer of a bucket removes its state.  Counts are kept in packed pieces.
    """

    def __init__(self, who: str, window: int, limit: int) -> None:
        self.who, self.window, self.limit = who, window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "piece binary")
        self.reported = handle.getValueState("reported", "upto bigint")

    def _wake_after(self, second: int) -> None:
        self.handle.registerTimer((second + 1) * 1000)  # runs once the watermark has reached it

    def _rows(self, counts: pa.Table, in_window: pa.Array, late: bool) -> pd.DataFrame:
        columns = [counts["who"], counts["second"], counts["n"], in_window, pc.greater_equal(in_window, self.limit), pa.array(np.full(len(counts), late))]
        return pa.table(columns, names=[self.who, "second", "requests", "in_window", "exceeded", "late"]).to_pandas(types_mapper=pd.ArrowDtype)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, bucket = key
        closed = _closed(timerValues)
        arrived = _unpacked([p for r in rows for p in r["packed"]])
        seconds = arrived["second"].to_numpy()
        own = seconds // self.window == bucket
        fresh = np.full(len(seconds), True) if closed is None else seconds >= closed
        if fresh.any():
            self._append(arrived.filter(pa.array(fresh)))
            self._wake_after(int(seconds[fresh & own].min()) if (fresh & own).any() else (bucket + 1) * self.window - 1)
        late = arrived.filter(pa.array(own & ~fresh))
        if len(late):
            yield self._rows(late, pa.nulls(len(late), pa.int64()), late=True)

    def _append(self, counts: pa.Table) -> None:
        self.counts.appendList([(_packed(counts.slice(at, PIECE_ROWS)),) for at in range(0, len(counts), PIECE_ROWS)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, bucket = key
        closed, end = _closed(timerValues), (bucket + 1) * self.window
        before = self.reported.get()[0] if self.reported.exists() else None
        pieces = [p for (p,) in self.counts.get()]
        upcoming = end - 1
        if pieces:
            held = _unpacked(pieces)
            seconds = held["second"].to_numpy()
            own = seconds // self.window == bucket
            due = own & (seconds < closed) & (True if before is None else seconds >= before)
            if due.any():
                yield self._rows(held.filter(pa.array(due)), pa.array(self._trailing(held)[due]), late=False)
            if (own & (seconds >= closed)).any():
                upcoming = int(seconds[own & (seconds >= closed)].min())
        if closed >= end:
            self.counts.clear()
            self.reported.clear()
            return
        self.reported.update((closed,))
        if pieces:
            still = seconds >= closed - self.window
            if len(pieces) > PIECES + len(seconds) // PIECE_ROWS or 2 * still.sum() < len(seconds):
                self.counts.clear()
                if still.any():
                    self._append(held.filter(pa.array(still)))
        self._wake_after(upcoming)

    def _trailing(self, counts: pa.Table) -> np.ndarray:
        """For each row, the requests of its requester from ``window`` seconds before it up to its second."""
        who = counts["who"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        seconds = counts["second"].to_numpy()
        since = seconds - seconds.min()
        place = who * (int(since.max()) + 1) + since
        order = np.argsort(place)
        sums = np.concatenate([[0], np.cumsum(counts["n"].to_numpy()[order])])
        first = np.searchsorted(place[order], place - np.minimum(since, self.window))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return sums[rank + 1] - sums[first]


def _closed(timer_values) -> int | None:
    """The first second that is still open; None before there is a watermark."""
    watermark = timer_values.getCurrentWatermarkInMs()
    return watermark // 1000 if watermark > 0 else None


def trailing_rates(stream: DataFrame, who: str, at: str, window_seconds: int, limit: int, lateness: str = "10 minutes") -> DataFrame:
    """``aggregates.rate_check`` on a stream: (who, second, requests, in_window, exceeded, late).

    A second is reported once, when the watermark (the latest time seen, less ``lateness``)
    has passed its end; its counts are then those of the plain form over all rows in time.
    Rows that arrive for a closed second are in no count; they are reported with ``late``
    true, their number as ``requests`` and NULL for the rest.  Rows without a time take no
    part, rows without a requester are one requester.

    Rows are counted per second and packed before the shuffle.  State is kept by group of
    requesters (``SPREAD`` of them, by hash) and window-long bucket, each second also in the
    next bucket, so a busy requester is spread over buckets, many that are seldom seen cost
    one call for the group, and a bucket's state goes when it is over.
    """
    kind = stream.schema[who].dataType
    timed = stream.select(F.col(who), F.col(at).cast("timestamp").alias("_at")).where("_at IS NOT NULL").withWatermark("_at", lateness)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            counts = pa.concat_tables(held).group_by(["who", "second", "shard"]).aggregate([("n", "sum")])
            shards, buckets = counts["shard"].to_numpy(), counts["second"].to_numpy() // window_seconds
            order = np.lexsort((buckets, shards))
            shards, buckets = shards[order], buckets[order]
            counts = counts.take(pa.array(order)).select(["who", "second", "n_sum"]).rename_columns(["who", "second", "n"]).combine_chunks()
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(buckets) != 0)) + 1
            starts = np.concatenate([[0], edges])
            for part in np.array_split(np.arange(len(starts)), len(starts) // 256 + 1):
                pieces = [_packed(counts.slice(starts[i], (starts[i + 1] if i + 1 < len(starts) else len(shards)) - starts[i])) for i in part.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shards[starts[part]], pa.int32()), pa.array(buckets[starts[part]], pa.int64()), pa.array(pieces, pa.binary())], names=["shard", "bucket", "packed"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]).group_by(["who", "second", "shard"]).aggregate([([], "count_all")]).rename_columns({"count_all": "n"}))
                size += held[-1].nbytes
            if size > HELD_BYTES:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    shard = F.pmod(F.xxhash64(who), F.lit(SPREAD)).cast("int")
    per_second = timed.select(F.col(who).alias("who"), F.unix_seconds("_at").alias("second"), shard.alias("shard")).mapInArrow(pack, "shard int, bucket bigint, packed binary")
    spread = per_second.select("shard", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), "packed")
    out = T.StructType([T.StructField(who, kind)] + [T.StructField(c, T.LongType()) for c in ("second", "requests", "in_window")] + [T.StructField(c, T.BooleanType()) for c in ("exceeded", "late")])
    return spread.groupBy("shard", "bucket").transformWithStateInPandas(_Trailing(who, window_seconds, limit), out, "Append", "EventTime")


def store_trailing_rates(rates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that is there now and store the reports of each batch, for a plain read of ``path``."""
    return store_updates(rates, path, checkpoint, "append")  # timers and list state need its RocksDB state store
