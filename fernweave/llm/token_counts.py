"""Count tokens without producing them.

A vocabulary entry is *whole* if merging its own characters ends in that one entry.  Which
entries are whole is proved once per vocabulary, by merging each of them.  A piece of text
equal to a whole entry is then one token by one table lookup; only the other pieces are
merged, and short ones are remembered in a table of a fixed size.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm.pretokens import pieces

MEMO_PIECES = 600_000
MEMO_PIECE_CHARS = 48

#: Pieces of up to this many bytes are merged without a queue.
SHORT_PIECE = 64
_NEVER = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()


def merged_length(symbols: str, merges: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the listed merges are applied, best first, leftmost on ties."""
    return _merged_short(symbols, merges) if len(symbols) <= SHORT_PIECE else _merged_long(symbols, merges)


def _merged_short(symbols: str, merges: dict[tuple[str, str], int]) -> int:
    """By looking for the best pair each time: quadratic, but quickest for a word."""
    parts = list(symbols)
    ranks = [merges.get(pair, _NEVER) for pair in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) < _NEVER:
        i = ranks.index(best)
        parts[i] += parts.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = merges.get((parts[i], parts[i + 1]), _NEVER)
        if i:
            ranks[i - 1] = merges.get((parts[i - 1], parts[i]), _NEVER)
    return len(parts)


def _merged_long(symbols: str, merges: dict[tuple[str, str], int]) -> int:
    """By a queue of pairs: about linear in the length."""
    n = len(symbols)
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rank, i) for i in range(n - 1) if (rank := merges.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(queue)
    left = n
    while queue:
        rank, i = heapq.heappop(queue)
        j = after[i]
        if parts[i] is None or j >= n or merges.get((parts[i], parts[j])) != rank:
            continue  # one of the two is gone, or has grown
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (ahead := merges.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(queue, (ahead, i))
        if (k := before[i]) >= 0 and (behind := merges.get((parts[k], parts[i]))) is not None:
            heapq.heappush(queue, (behind, k))
        left -= 1
    return left


@dataclass
class TokenCounter:
    """Counts tokens of one byte-level vocabulary."""

    merges: dict[tuple[str, str], int]
    whole: dict[str, int]
    specials: tuple[str, ...]
    _counts: dict[str, int] = field(default_factory=dict, repr=False)

    @classmethod
    def from_file(cls, path: str) -> TokenCounter:
        """Read a tokenizer file and prove which of its entries are whole.

        Only the plain byte-level form is accepted; anything that would change counts in
        another way (a normaliser, a prefix space, special strings with own rules) raises.
        """
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and spec["normalizer"] is None
        if not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special strings with rules about their surroundings are not supported")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        merges = {pair: rank for rank, pair in enumerate(pairs)}
        byte_of = {c: b for b, c in _ALPHABET.items()}
        whole = {}
        for entry in model["vocab"]:
            if all(c in byte_of for c in entry) and merged_length(entry, merges) == 1:
                try:
                    whole[bytes(byte_of[c] for c in entry).decode()] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a piece of text by itself
        specials = tuple(sorted((t["content"] for t in added), key=len, reverse=True))
        return cls(merges, whole, specials)

    def __getstate__(self) -> dict:
        return {"merges": self.merges, "whole": self.whole, "specials": self.specials}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _counts={})

    def _merged(self, piece: str) -> int:
        found = merged_length(piece.encode().decode("latin-1").translate(_ALPHABET), self.merges)
        if len(piece) <= MEMO_PIECE_CHARS:
            if len(self._counts) >= MEMO_PIECES:
                self._counts.clear()
            self._counts[piece] = found
        return found

    def _plain(self, text: str) -> int:
        whole, counts, total = self.whole, self._counts, 0
        for run in pieces(text):
            for piece in run:
                total += whole.get(piece) or counts.get(piece) or self._merged(piece)
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it is one token and parts the text."""
        if not text:
            return 0
        present = [s for s in self.specials if s in text]
        if not present:
            return self._plain(text)
        parts = re.split("|".join(map(re.escape, present)), text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_column(text: Column | str, counter: Broadcast) -> Column:
    """Number of tokens of each whole text; 0 for NULL and empty texts."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array((counter.value.count(t.as_py()) for t in texts), pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, counter: Broadcast, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text, and whether it has more than ``limit`` tokens.

    Returns (id, n_bytes, n_tokens, over_limit).  NULL and empty texts have 0 of both.  Rows
    stand alone: repeated rows and NULL ids are returned as they come, an empty table gives
    an empty result, other columns of ``docs`` are not carried and cannot clash.
    """
    counted = docs.select(
        F.col(id_col), F.coalesce(F.octet_length(F.col(text_col)).cast("bigint"), F.lit(0).cast("bigint")).alias("n_bytes"), count_column(F.col(text_col), counter).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
