"""Byte-level BPE encoding and decoding of rank files, in time linear in the text.

The encoder never merges.  It walks over a piece of text, always trying the longest
vocabulary entry that starts where it stands (an Aho-Corasick automaton over the bytes,
taken as Latin-1 characters, finds them all in one pass), and accepts an entry only if it
is *compatible* with the one before: if merging the two byte strings side by side would
never have joined bytes across their border.  Where no entry fits, the position is marked
dead and the walk goes back by one entry.  Every position dies at most once, so the walk is
linear; the result is exactly the one that merging gives, because a sequence whose
neighbours are all compatible is the only fixed point of merging.

Answers about neighbours and about short pieces are memoised in tables of a fixed size.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.pretokens import pieces
from fernweave.llm.stored import small_batches

#: Bounds of the memo tables; a full table is emptied.
MEMO_PIECES = 300_000
MEMO_PIECE_CHARS = 48
MEMO_PAIRS = 300_000

#: Ids decoded in one step.
DECODE_RUN = 1 << 16

_NEVER = 1 << 62


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two entries whose merge gives the token, or None if merging its bytes does not end there."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not joined:
            return None
        _, i = min(joined)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Codec:
    """Encoder and decoder of one vocabulary; what the walk needs is built on first use in each process."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif (pair := _last_merge(token, ranks)) is not None:
                self.halves[rank] = pair
        self._ready = False

    @classmethod
    def from_file(cls, path: str) -> Codec:
        return cls(read_ranks(path))

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "halves": self.halves}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _ready=False)

    def _prepare(self) -> None:
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens, self.sizes = tokens, [len(t) for t in tokens]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array(self.sizes, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.shorter = [-1] * len(tokens)  # the longest mergeable entry that is a proper prefix of this one
        for rank in self.halves:
            raw = tokens[rank]
            self.automaton.add_word(raw.decode("latin-1"), rank)
            prefixes = (self.ranks.get(raw[:n], -1) for n in range(len(raw) - 1, 0, -1))
            self.shorter[rank] = next((p for p in prefixes if p in self.halves), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self._ready = True

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both entries side by side keeps their border.

        The merges are taken back, latest first; at each step the two parts that touch at
        the border must not have been the better merge (a lower rank, or the same further left).
        """
        tokens, ranks, halves, limit = self.tokens, self.ranks, self.halves, _NEVER
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            left_whole, right_whole = halves[left][0] == left, halves[right][0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    def encode_piece(self, raw: bytes) -> list[int]:
        """The entries of one piece of text."""
        if not self._ready:
            self._prepare()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        end, sizes, shorter, fits = len(raw), self.sizes, self.shorter, self.fits
        longest = [0] * end
        for last, token in self.automaton.iter(raw.decode("latin-1")):
            longest[last + 1 - sizes[token]] = token  # later matches from the same start are longer
        dead = bytearray(end + 1)
        out: list[int] = []
        at, before, token = 0, -1, longest[0]
        while at < end:
            stop = at + sizes[token]
            if not dead[stop]:
                known = fits.get(before << 32 | token) if out else True
                if known is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    known = fits[before << 32 | token] = self._compatible(before, token)
                if known:
                    out.append(token)
                    at, before = stop, token
                    if at < end:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:  # nothing fits here: this position is dead, go back by one entry
                dead[at] = 1
                gone = out.pop()
                at -= sizes[gone]
                before, token = out[-1] if out else -1, shorter[gone]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self._ready:
            self._prepare()
        memo, out = self.memo, []
        for run in pieces(text):
            for piece in run:
                packed = memo.get(piece)
                if packed is None:
                    packed = _pack(self.encode_piece(piece.encode()))
                    if len(piece) <= MEMO_PIECE_CHARS:
                        if len(memo) >= MEMO_PIECES:
                            memo.clear()
                        memo[piece] = packed
                out.append(packed)
        return b"".join(out)

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        if not self._ready:
            self._prepare()
        ids, parts = np.frombuffer(packed or b"", "<u4"), []
        for at in range(0, len(ids), DECODE_RUN):
            run = ids[at : at + DECODE_RUN]
            lengths = self.lengths[run]
            ends = np.cumsum(lengths)
            places = np.repeat(self.starts[run] - (ends - lengths), lengths)
            parts.append(self.flat[places + np.arange(len(places))].tobytes())
        return b"".join(parts)


def share(spark: SparkSession, codec: Codec) -> Broadcast:
    """The codec on every executor; its size is that of the vocabulary, whatever the data."""
    small_batches(spark)
    return spark.sparkContext.broadcast(codec)


def _each(values: pa.Array) -> Iterator:
    return (v.as_py() for v in values)


def encode_column(text: Column | str, codec: Broadcast) -> Column:
    """Packed ids (little-endian unsigned 32-bit) of each whole text; NULL and empty texts give no ids."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(map(codec.value.encode, _each(texts)), pa.binary())

    return encode(text)


def decode_column(packed: Column | str, codec: Broadcast) -> Column:
    """The bytes behind packed ids; NULL gives no bytes."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array(map(codec.value.decode, _each(ids)), pa.binary())

    return decode(packed)


def coded_column(text: Column | str, codec: Broadcast) -> Column:
    """Packed ids of each whole text and the bytes they decode to, in one visit to Python."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def coded(texts: pa.Array) -> pa.Array:
        ids = [codec.value.encode(t) for t in _each(texts)]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(codec.value.decode, ids), pa.binary())], names=["ids", "decoded"])

    return coded(text)


def round_trip(docs: DataFrame, codec: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids again: (id, ids, n_tokens, decoded).

    Nothing is shuffled, each row stands alone.  NULL and empty texts: no ids, no bytes.
    Repeated rows and NULL ids are returned as they come; an empty table gives an empty
    result.  Other columns of ``docs`` are not carried, so their names cannot clash.
    """
    made = docs.select(F.col(id_col), coded_column(F.col(text_col), codec).alias("__fw_c"))
    return made.select(id_col, "__fw_c.ids", F.expr("cast(octet_length(__fw_c.ids) div 4 as bigint)").alias("n_tokens"), "__fw_c.decoded")
