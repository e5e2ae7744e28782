"""Splitting oversized texts at natural boundaries, by structure-tree packing.

A text is parsed into a tree: sections by heading depth, in them paragraphs, lists by indentation, fenced
code, tables and markup blocks, in those lines, sentences and words. Packing goes bottom-up: sibling
subtrees that fit are merged up to the limit, a subtree that does not fit is descended into and its packs
stand for themselves, down to single characters where a text has no boundary at all.
"""

from __future__ import annotations

import array
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.llm import bpe
from braidframe.session import ship, spread

#: A limit table of at most so many rows is broadcast.
MOST_LIMITS = 100_000
#: Rows of a batch handed back to Spark at once.
_FLUSH_ROWS = 2_000

#: Depths of the tree: sections 1 to 6 by heading, blocks, parts of a block (items by indentation, rows, lines).
_BLOCK, _ITEM, _LINE = 7, 8, 40
_DEEPEST_ITEM = 30

_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s|$)|\s*<[hH]([1-6])[\s>]|(={1,6})\s.*\S\s*=+\s*$")
_UNDERLINE = re.compile(r" {0,3}(?:(=+)|(-{2,}))\s*$")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_BULLET = re.compile(r"([ \t]*)(?:[-*+](?=\s)|[•‣◦]|\d{1,4}[.)](?=\s)|\[\d+\]|<li\b[^>]*>)")
_TABLE = re.compile(r"\s*\|")
_MARKUP = re.compile(r"\s*</?(?:p|div|section|article|table|ul|ol|dl|blockquote|pre|figure|header|footer|main|nav|aside|body|head)\b", re.IGNORECASE)
#: Markup in the middle of a line begins a block as well.
_INLINE_MARKUP = re.compile(r"(?=<(?:h[1-6]|p|div|section|article|table|tr|ul|ol|li|dl|dt|dd|blockquote|pre|figure|header|footer|main|nav|aside)\b)", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…:;]+[\"')\]»”’]*\s+|[。！？；]+[」』”’]*\s*")


def _units(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of lines; a line is also cut before block markup in its middle."""
    for m in _LINES.finditer(text):
        line, at = m.group(), m.start()
        if "<" in line:
            begin = 0
            for cut in _INLINE_MARKUP.finditer(line):
                if cut.start() > begin and line[begin : cut.start()].strip():
                    yield at + begin, line[begin : cut.start()]
                    begin = cut.start()
            yield at + begin, line[begin:]
        else:
            yield at, line


def outline(text: str) -> list[tuple[int, int]]:
    """(start, depth) of the nodes of a text's tree in order; a node ends where one of no greater depth begins.

    Headings: ``#``, underlined, ``= x =`` and ``<h1>``; inside fenced code nothing is read as structure.
    Blank lines belong to the node before them.
    """
    nodes: list[tuple[int, int]] = []
    fence, kind, fresh, alone = "", "", True, False
    for start, line in _units(text):
        body = line.strip()
        if fence:
            nodes.append((start, _LINE))
            if body.startswith(fence) and not body.strip(fence[0]):
                fence, fresh = "", True
            continue
        if not body:
            fresh, alone = True, False
            continue
        if m := _FENCE.match(line):
            fence, kind, alone = m[1], "code", False
            nodes.append((start, _BLOCK))
        elif m := _HEADING.match(line):
            nodes.append((start, len(m[1]) if m[1] else int(m[2]) if m[2] else len(m[3])))
            fresh, kind, alone = True, "", False
        elif alone and (m := _UNDERLINE.match(line)):
            nodes[-1] = (nodes[-1][0], 1 if m[1] else 2)  # the paragraph's only line so far was a heading
            fresh, kind, alone = True, "", False
        else:
            bullet, now = _BULLET.match(line), "text"
            if bullet:
                now = "list"
            elif _TABLE.match(line):
                now = "table"
            elif _MARKUP.match(line):
                now = "markup"
            # an indented or directly following line goes on with the item
            indented = kind == "list" and now == "text" and (line[0] in " \t" or not fresh)
            if bullet and kind == "list":
                nodes.append((start, _ITEM + min(_DEEPEST_ITEM, len(bullet[1].expandtabs(4)))))
            elif now == "markup" or (now != kind and not indented) or (fresh and not indented):
                nodes.append((start, _BLOCK))
                if bullet:
                    nodes.append((start, _ITEM + min(_DEEPEST_ITEM, len(bullet[1].expandtabs(4)))))
                kind = now
                alone = now == "text"
                fresh = False
                continue
            else:
                nodes.append((start, _LINE))
            fresh, alone = False, False
    if not nodes or nodes[0][0] > 0:
        nodes.insert(0, (0, _BLOCK))
    return nodes


class Measured:
    """A text whose tokens are counted once: every run of the tokenizer's pattern with its number of tokens.

    Runs are encoded one by one, so the count of any stretch is that of the whole runs in it, by
    difference, and of the cut runs at its ends.
    """

    def __init__(self, enc: bpe.Encoder, text: str) -> None:
        self.text, self.ids = text, enc.ids_of_run
        runs = enc.runs.findall(text)
        self.ends = list(accumulate(map(len, runs), initial=0))
        self.total = list(accumulate((len(self.ids(r)) // 4 for r in runs), initial=0))

    def count(self, a: int, b: int) -> int:
        """Tokens of text[a:b]."""
        ends = self.ends
        i, j = bisect_left(ends, a), bisect_right(ends, b) - 1  # whole runs reach from ends[i] to ends[j]
        if i > j:
            return len(self.ids(self.text[a:b])) // 4 if a < b else 0
        n = self.total[j] - self.total[i]
        if ends[i] > a:
            n += len(self.ids(self.text[a : ends[i]])) // 4
        if ends[j] < b:
            n += len(self.ids(self.text[ends[j] : b])) // 4
        return n

    def borders(self, a: int, b: int) -> list[int]:
        """Ends of runs in (a, b], and b."""
        found = self.ends[bisect_right(self.ends, a) : bisect_right(self.ends, b)]
        return found if found and found[-1] == b else [*found, b]


class Splitter:
    """Cuts texts by one encoder."""

    def __init__(self, enc: bpe.Encoder) -> None:
        self.enc = enc
        self.length = [0] * (max(enc.ranks.values()) + 1)
        for token, i in enc.ranks.items():
            self.length[i] = len(token)

    def pieces(self, text: str, limit: int, overlap: int, measured: Measured | None = None) -> list[tuple[int, int, int, int]]:
        """(start, fresh start, end, tokens) of each piece of an oversized text.

        The fresh parts [fresh start, end) follow one another without gap; [start, fresh start) repeats
        the end of the piece before, by ``overlap`` tokens. Every piece is at most ``limit`` tokens, but
        for single characters that need more by themselves.
        """
        m = measured or Measured(self.enc, text)
        limit = max(1, limit)
        overlap = max(0, min(overlap, limit - 1))
        todo = [(a, b) for a, b, _ in reversed(self._pack(m, limit - overlap))]
        out: list[tuple[int, int, int, int]] = []
        while todo:
            a, b = todo.pop()
            start = self._back(m, a, overlap, out[-1][0]) if out and overlap else a
            n = m.count(start, b)
            if n > limit:  # tokens across a seam can be more than their parts
                cut = self._fit(m, start, a, b, limit)
                if cut == a and start < a:  # not one more character fits: a shorter overlap must do
                    while start < a and m.count(start, a + 1) > limit:
                        start += 1
                    cut = self._fit(m, start, a, b, limit)
                cut = max(cut, a + 1)
                if cut < b:
                    todo.append((cut, b))
                b, n = cut, m.count(start, cut)
            out.append((start, a, b, n))
        return out

    def _pack(self, m: Measured, room: int) -> list[tuple[int, int, int]]:
        """Consecutive (start, end, tokens) of at most ``room`` tokens each."""
        nodes = outline(m.text)
        starts = [*(s for s, _ in nodes), len(m.text)]
        out: list[tuple[int, int, int]] = []
        # (first, last) are the nodes of a run of siblings with all that is below them
        todo = [(0, len(nodes))]
        while todo:
            first, last = todo.pop()
            size = m.count(starts[first], starts[last])
            if size <= room:
                out.append((starts[first], starts[last], size))
                continue
            if last - first == 1:
                out += self._inside(m, starts[first], starts[last], room)
                continue
            # the children: a head that comes before the first of them, and each with what is below it
            top = min(depth for _, depth in nodes[first + 1 : last])
            cuts = [first, *(i for i in range(first + 1, last) if nodes[i][1] == top), last]
            groups: list[tuple[int, int]] = []
            held, held_size = None, 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = m.count(starts[a], starts[b])
                if held is not None and n <= room and held_size + n <= room and m.count(starts[held], starts[b]) <= room:
                    groups[-1], held_size = (held, b), held_size + n
                else:
                    groups.append((a, b))
                    held, held_size = (a, n) if n <= room else (None, 0)
            todo.extend(reversed(groups))
        return out

    def _inside(self, m: Measured, a: int, b: int, room: int) -> list[tuple[int, int, int]]:
        """Packs within one line: sentences, then words, then characters; each level merged by itself."""
        parts: list[tuple[int, int, int]] = []
        at = a
        for end in [*(x.end() for x in _SENTENCE.finditer(m.text, a, b)), b]:
            if end <= at:
                continue
            n = m.count(at, end)
            if n <= room:
                if parts and parts[-1][2] + n <= room:
                    parts[-1] = (parts[-1][0], end, parts[-1][2] + n)
                else:
                    parts.append((at, end, n))
            else:
                parts += self._words(m, at, end, room)
                parts.append((end, end, room))  # nothing is merged across an oversized sentence
            at = end
        return [p for p in parts if p[0] < p[1]]

    def _words(self, m: Measured, a: int, b: int, room: int) -> list[tuple[int, int, int]]:
        parts: list[tuple[int, int, int]] = []
        at = a
        for end in m.borders(a, b):
            n = m.count(at, end)
            if n > room:
                parts += self._characters(m, at, end, room)
            elif parts and parts[-1][2] + n <= room:
                parts[-1] = (parts[-1][0], end, parts[-1][2] + n)
            else:
                parts.append((at, end, n))
            at = end
        return parts

    def _characters(self, m: Measured, a: int, b: int, room: int) -> list[tuple[int, int, int]]:
        """A run without boundary, cut where tokens of the run end at characters."""
        parts, at, want, at_tokens, n, byte = [], a, a, 0, 0, 0
        ends = _byte_ends(m.text, a, b)  # byte offset -> character that starts there
        for i in array.array("i", self.enc.encode_bytes(m.text[a:b])):
            byte += self.length[i]
            n += 1
            here = ends.get(byte)
            if here is not None:
                if n > room and want > at:
                    parts += self._checked(m, at, want, room)
                    at = want
                    n -= at_tokens
                want, at_tokens = here, n
        if at < b:
            parts += self._checked(m, at, b, room)
        return parts

    def _checked(self, m: Measured, a: int, b: int, room: int) -> list[tuple[int, int, int]]:
        """[a, b) in as many parts as it takes by its own count."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            n = m.count(a, b)
            if n <= room or b - a == 1:
                out.append((a, b, n))
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        return out

    def _back(self, m: Measured, at: int, overlap: int, least: int) -> int:
        """Where the last ``overlap`` tokens before ``at`` begin, not before ``least``."""
        ends, n = m.ends, 0
        i = bisect_left(ends, at)  # the runs before ``at`` end at ends[i - 1] at the latest
        low, high = bisect_left(ends, least, 0, i), i
        while low < high:  # the first run border from which no more than the overlap is left
            mid = (low + high) // 2
            if ends[mid] >= at or m.count(ends[mid], at) <= overlap:
                high = mid
            else:
                low = mid + 1
        start = min(ends[low], at) if low < len(ends) else at
        n = m.count(start, at)
        before = max(ends[low - 1] if low else 0, least)
        if n == overlap or before >= start:
            return start
        # the rest comes from inside the run before that border, where one of its tokens begins
        ids = array.array("i", self.enc.encode_bytes(m.text[before:start]))
        offsets, byte = _byte_ends(m.text, before, start), sum(self.length[i] for i in ids)
        guess = start
        for i in reversed(ids[max(0, len(ids) - (overlap - n)) :]):
            byte -= self.length[i]
            guess = offsets.get(byte, guess)
        for step in range(33):  # a start inside a word can be encoded otherwise: look around it
            for other in (guess - step, guess + step):
                if before <= other < start and m.count(other, at) == overlap:
                    return other
        while guess < start and m.count(guess, at) > overlap:
            guess += 1
        return guess

    def _fit(self, m: Measured, start: int, a: int, b: int, limit: int) -> int:
        """The furthest end in (a, b] whose piece from ``start`` fits, at a word's border if there is one; else a."""
        for ends in (m.borders(a, b), range(a + 1, b + 1)):
            low, high = 0, len(ends)
            while low < high:
                mid = (low + high) // 2
                if m.count(start, ends[mid]) <= limit:
                    low = mid + 1
                else:
                    high = mid
            while low:
                if m.count(start, ends[low - 1]) <= limit:
                    return ends[low - 1]
                low -= 1
        return a


def _byte_ends(text: str, a: int, b: int) -> dict[int, int]:
    """Byte offset from ``a`` -> character position, for every character of [a, b) and its end."""
    out, byte = {0: a}, 0
    for i in range(a, b):
        c = ord(text[i])
        byte += 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4
        out[byte] = i + 1
    return out


_PIECE = "piece bigint, n_pieces bigint, start bigint, fresh_start bigint, end bigint, n_tokens bigint, doc_tokens bigint"


def split_oversized(docs: DataFrame, limits: DataFrame, *, with_text: bool = True, rank_file: str = bpe.RANK_FILE) -> DataFrame:
    """Pieces of every text above its source's limit: (doc_id, source, piece, n_pieces, start, fresh_start, end, n_tokens, doc_tokens, text).

    ``start`` and ``end`` are character positions; the part before ``fresh_start`` repeats the end of
    the piece before. Texts within their limit, null and empty texts and texts of sources without a
    limit give no rows. Of several limits for one source the least ``max_tokens`` counts, with the least
    overlap; a null overlap is none. Rows repeated in ``docs`` are split each time; other columns are
    ignored. ``with_text=False`` leaves the texts out.
    """
    known = limits.where(F.col("source").isNotNull() & F.col("max_tokens").isNotNull())
    rows = known.groupBy("source").agg(F.min("max_tokens").cast("bigint").alias("max_tokens"), F.coalesce(F.min("overlap_tokens"), F.lit(0)).cast("bigint").alias("overlap_tokens"))
    first = rows.limit(MOST_LIMITS + 1).collect()
    control = rows  # more limits than that are joined, not broadcast
    if len(first) <= MOST_LIMITS:
        control = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in first], "source string, max_tokens bigint, overlap_tokens bigint"))
    # A token has at least one byte, so most texts are seen to fit without being encoded.
    large = docs.select("doc_id", "source", "text").join(control, "source").where(F.octet_length("text") > F.col("max_tokens"))
    ship(docs.sparkSession)
    large = spread(large, "doc_id", source=docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(rank_file)
        splitter = Splitter(enc)
        for batch in batches:
            limits_, overlaps, texts = (batch.column(n).to_pylist() for n in ("max_tokens", "overlap_tokens", "text"))
            at, numbers, parts = [], [], []
            for i, text in enumerate(texts):
                m = Measured(enc, text)
                n = m.total[-1]
                if n <= limits_[i]:
                    continue
                found = splitter.pieces(text, limits_[i], overlaps[i], m)
                for first in range(0, len(found), _FLUSH_ROWS):
                    part = found[first : first + _FLUSH_ROWS]
                    at += [i] * len(part)
                    numbers += [(first + k, len(found), *p, n) for k, p in enumerate(part)]
                    if with_text:
                        parts += [text[p[0] : p[2]] for p in part]
                    if len(at) >= _FLUSH_ROWS:
                        yield pack(batch, at, numbers, parts)
                        at, numbers, parts = [], [], []
            if at:
                yield pack(batch, at, numbers, parts)

    def pack(batch: pa.RecordBatch, at: list, numbers: list, parts: list) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)] + ([pa.array(parts, pa.string())] if with_text else [])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("source").take(take), *columns], names=[f.name for f in schema])

    schema = T.StructType([docs.schema["doc_id"], docs.schema["source"], *T._parse_datatype_string(f"struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>")])
    if with_text:
        schema = schema.add("text", T.StringType())
    return large.select("doc_id", "source", "max_tokens", "overlap_tokens", "text").mapInArrow(bpe.without_gc(run), schema)
