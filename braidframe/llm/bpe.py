"""Byte-pair encoding of whole corpora with a public rank file.

A text is cut by the tokenizer's pattern into pieces, and each piece is merged by a segment tree over its
byte positions: a leaf holds the rank of the pair that starts there, every inner node the leftmost least
of its halves. The root names the next merge; a merge changes the leaf itself, its live left neighbour
and the swallowed right one, each in logarithmic time, so a piece of n bytes takes n log n whatever it
holds.
"""

from __future__ import annotations

import array
import base64
import functools
import gc
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.session import ship, spread

#: Rank file of byte_bpe_50k; a parameter of every operator here.
RANK_FILE = os.environ.get("BRAIDFRAME_RANK_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# The contractions that the pattern of byte_bpe_50k keeps whole, and the code points that
# it counts as white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = r"\t-\r\x20\x85\xa0  -     　"

#: Remembered encodings of a worker; when so many are held they are forgotten and learned anew.
REMEMBERED = 400_000
#: Longer runs without white space are not remembered.
LONGEST_REMEMBERED = 64


#: Letters and numbers are assigned in planes 0 to 3 only.
_ASSIGNED = 0x40000


def _class_of(initial: str) -> str:
    """All code points whose general category starts with ``initial``, as the inside of a character class."""
    spans: list[list[int]] = []
    for c in range(_ASSIGNED):
        if unicodedata.category(chr(c))[0] == initial:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(runs, pieces of ASCII text, pieces of any text).

    A run is white space and the word after it. No piece reaches across the border before white space
    that follows something else, and no rule looks back, so runs can be encoded one by one. Which
    alternative matches depends on the first characters only, so letters can be tried first.
    """
    short = "|".join(CONTRACTIONS)
    runs = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    make = lambda letter, digit: re.compile(f" ?[{letter}]+| ?[{digit}]+|{short}| ?[^{WHITE}{letter}{digit}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    return runs, make("A-Za-z", "0-9"), make(_class_of("L"), _class_of("N"))


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of least rank.

    The empty piece has no ids. Every single byte must be in ``ranks``.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    none = 1 << 62
    get = ranks.get
    ends = list(range(1, n + 1))  # where the symbol that starts here ends
    size = 1
    while size < n:
        size *= 2
    # key = rank * size + position: the least key is the least rank, leftmost among equals
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(at: int, key: int) -> None:
        node = size + at
        tree[node] = key
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                return
            tree[node] = best
            node >>= 1

    before = list(range(-1, n - 1))  # start of the live symbol to the left
    while tree[1] != none:
        at = tree[1] % size
        gone = ends[at]
        end = ends[at] = ends[gone]
        put(gone, none)
        if end < n:
            before[end] = at
            r = get(piece[at : ends[end]])
            put(at, none if r is None else r * size + at)
        else:
            put(at, none)
        left = before[at]
        if left >= 0:
            r = get(piece[left:end])
            put(left, none if r is None else r * size + left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


class Encoder:
    """Encodes texts; remembers pieces and runs, since most of them recur."""

    def __init__(self, rank_file: str = RANK_FILE) -> None:
        self.ranks = ranks_of(rank_file)
        self.runs, self.ascii_pieces, self.any_pieces = _patterns()
        self.pieces: dict[str, bytes] = {}
        self.seen = _Runs(self)
        self.ids_of_run = self.seen.__getitem__

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern, as native 32-bit integers."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array.array("i", merge_piece(piece.encode(), self.ranks)).tobytes()
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """The pieces of a text by the tokenizer's pattern."""
        return (self.ascii_pieces if text.isascii() else self.any_pieces).findall(text)

    def run(self, run: str) -> bytes:
        known = self.pieces.get(run)
        return b"".join([self.piece(p) for p in self.split(run)]) if known is None else known

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as native 32-bit integers; nothing for null and empty texts."""
        if not text:
            return b""
        return b"".join(map(self.seen.__getitem__, self.runs.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without special tokens: their spellings are ordinary text."""
        return array.array("i", self.encode_bytes(text)).tolist()

    def count(self, text: str | None) -> int:
        """Number of ids of a whole text."""
        return len(self.encode_bytes(text)) // 4


class _Runs(dict):
    """Encodings of runs, made when they are first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        ids = self.encoder.run(run)
        if len(run) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = ids
        return ids


@functools.cache
def encoder(rank_file: str = RANK_FILE) -> Encoder:
    """The encoder of this worker; it lives as long as the worker, so its memory serves all its tasks."""
    return Encoder(rank_file)


def without_gc(run: Callable) -> Callable:
    """A batch function during which cycles are not looked for: nothing here makes any, and what is remembered is costly to scan."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return quiet


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """(key, ids) of every row: ids is an array of integers, empty for null and empty texts.

    One row per input row, repeated rows and null keys included; other columns are ignored. Texts of
    any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            parts = [enc.encode_bytes(t) for t in batch.column("__text").to_pylist()]
            offsets = array.array("i", [0])
            at = 0
            start = 0
            for i, part in enumerate(parts):
                if at + len(part) // 4 > 2**31 - 1:
                    yield pack(batch, start, parts[start:i], offsets)
                    start, at, offsets = i, 0, array.array("i", [0])
                at += len(part) // 4
                offsets.append(at)
            yield pack(batch, start, parts[start:], offsets)

    def pack(batch: pa.RecordBatch, start: int, parts: list[bytes], offsets: array.array) -> pa.RecordBatch:
        values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
        lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())]), values)
        return pa.RecordBatch.from_arrays([batch.column("__key").slice(start, len(parts)), lists], names=[key, "ids"])

    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key")
    return rows.mapInArrow(without_gc(run), T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", rank_file: str = RANK_FILE, source: DataFrame | None = None) -> DataFrame:
    """(keep, n_tokens) of every row; 0 for null and empty texts. ``source``: the scan behind ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file)
        for batch in batches:
            counts = pa.array([enc.count(t) for t in batch.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), counts], names=[*keep, "n_tokens"])

    ship(docs.sparkSession)
    rows = spread(docs.select(*keep, F.col(text).alias("__text")), keep[0], source=source)
    return rows.mapInArrow(without_gc(run), T.StructType([*(docs.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())]))
