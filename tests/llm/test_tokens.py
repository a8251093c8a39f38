"""Encoding, decoding and counting against the tokenizer libraries."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from fernweave.llm import bpe, pretokens, queries, token_counts

LETTERS = st.text(st.sampled_from("abcdeéè'sß漢字٣²ſ \t\n\x1c\x85​　\U0001f600,.!-12<|>"), max_size=60)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.codec().ranks, special_tokens={})


@pytest.fixture(scope="module")
def counting():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS, st.text(max_size=60)))
def test_any_text_is_encoded_as_by_the_library(library, counting, text):
    codec = queries.codec()
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()
    assert queries.counter().count(text) == len(counting.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=8))
def test_any_sequence_of_entries_is_encoded_as_by_the_library(library, entries):
    codec = queries.codec()
    codec.encode("x")
    text = b"".join(codec.tokens[i] for i in entries).decode(errors="replace")
    assert ids(codec.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000 + "b", "ab" * 3000, " " * 4000 + "x", "é" * 2000, "aaab" * 999, "\n" * 70])
def test_long_pieces(library, text):
    assert ids(queries.codec().encode(text)) == library.encode_ordinary(text)
    assert queries.counter().count(text) == len(library.encode_ordinary(text))


def test_other_vocabulary():
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in ("größer où ¿qué? 漢字", "the internationalisation", "zzzzzzzz"):
        assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_runs_of_pieces_and_full_memos_change_nothing(library, monkeypatch):
    text = "some words, très bien 12 of a text that is cut up " * 20
    for module, name, value in ((pretokens, "LONG_TEXT", 10), (pretokens, "RUN", 3), (bpe, "MEMO_PIECES", 2), (bpe, "MEMO_PAIRS", 2), (bpe, "DECODE_RUN", 4), (token_counts, "MEMO_PIECES", 2), (token_counts, "SHORT_PIECE", 1)):
        monkeypatch.setattr(module, name, value)
    codec = bpe.Codec(queries.codec().ranks)
    counter = token_counts.TokenCounter(queries.counter().merges, queries.counter().whole, queries.counter().specials)
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()
    assert counter.count(text) == len(library.encode_ordinary(text))


def test_both_patterns_agree_on_ascii():
    text = "I'm  sure it's 12.5% \n\n of  them're\tthere 'S 'll"
    assert pretokens._ascii.findall(text) == pretokens._general.findall(text)


def test_special_string_is_one_token(counting):
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "x <|endoftext|>"):
        assert queries.counter().count(text) == len(counting.encode(text, add_special_tokens=False).ids)


def test_rows_of_any_kind(spark, odd, empty, library):
    codec, counter = bpe.share(spark, queries.codec()), bpe.share(spark, queries.counter())
    coded = bpe.round_trip(odd, codec)
    assert coded.columns == ["doc_id", "ids", "n_tokens", "decoded"]
    want = sorted((str(r[0]), tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ODD)
    assert sorted((str(r.doc_id), tuple(ids(r.ids)), bytes(r.decoded)) for r in coded.collect()) == want
    counted = token_counts.count_tokens(odd, counter, limit=5)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()) == sorted((k, len(b), len(t), len(t) > 5) for k, t, b in want)
    apart = odd.select("doc_id", bpe.encode_column("text", codec).alias("packed")).withColumn("back", bpe.decode_column("packed", codec))
    assert sorted((str(r.doc_id), tuple(ids(r.packed)), bytes(r.back)) for r in apart.collect()) == want
    assert bpe.round_trip(empty, codec).count() == 0 and token_counts.count_tokens(empty, counter).count() == 0


def test_queries_over_the_table(spark, small, library, counting):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, small).collect():
        want = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    for r in queries.op4_token_counts(spark, small).collect():
        n = len(counting.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)
