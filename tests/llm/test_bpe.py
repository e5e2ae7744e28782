import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from braidframe.llm import bpe

# Fixed value: the public pattern of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def peer():
    return tiktoken.Encoding("peer", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(bpe.RANK_FILE), special_tokens={})


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_segment_tree_equals_naive_merging(piece):
    ranks = bpe.ranks_of(bpe.RANK_FILE)
    assert bpe.merge_piece(piece, ranks) == naive(piece, ranks)


def test_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"aa": 1}
    assert bpe.merge_piece(b"aaaaa", ranks) == [1, 1, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    peer = tiktoken.Encoding("peer", pat_str=PATTERN, mergeable_ranks=bpe.ranks_of(bpe.RANK_FILE), special_tokens={})
    assert bpe.encoder().encode(text) == peer.encode_ordinary(text)


def test_white_space_and_marks(peer):
    rng = random.Random(1)
    alphabet = " \t\n\r\x0b\x1c\x1f\x85   　​﻿'sdtlvemréß中😀0½ⅷ_-.!A<|>"
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert bpe.encoder().encode(text) == peer.encode_ordinary(text)


def test_special_spelling_is_ordinary_text(peer):
    ids = bpe.encoder().encode("a<|endoftext|>b")
    assert 50256 not in ids and ids == peer.encode_ordinary("a<|endoftext|>b")


def test_long_piece_without_boundary(peer):
    text = "ab" * 100_000 + "中" * 5000
    assert bpe.encoder().count(text) == len(peer.encode_ordinary(text))


def test_forgetting_changes_nothing(peer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    enc = bpe.Encoder()
    text = "one two three four five six seven one two 12345 again"
    assert [enc.encode(text) for _ in range(3)] == [peer.encode_ordinary(text)] * 3


def test_corpus(spark, peer):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, " \n", "x"), (5, "naïve 中文 😀" * 50, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, peer.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    counts = bpe.count_tokens(df, ["doc_id"]).collect()
    assert sum(r["n_tokens"] for r in counts) == sum(len(v) for _, v in got)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert bpe.encode_corpus(df).schema["ids"].dataType.simpleString() == "array<int>"
