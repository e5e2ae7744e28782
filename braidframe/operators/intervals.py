"""Overlapping and gapped time intervals, by canonical dyadic blocks.

An interval [start, end) of whole numbers is the disjoint union of at most two aligned blocks of each
power-of-two size. Blocks of six neighbouring sizes that share an aligned parent of 64 slots are kept as
one 64-bit word, so uniting siblings six levels deep is a bitwise or, and a full word is one slot of the
word above it. Intervals travel as they are, cut at the borders of cells of 2**36 units, one small row
each; their blocks exist only inside a task, as arrays of a whole Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidframe.session import ship

#: Slots of a word are 2**6.
STEP = 6
#: Word levels of a cell of 2**(STEP * LEVELS) units: 2**36 us are 19 hours.
LEVELS = 6
CELL_BITS = STEP * LEVELS
#: Added to positions (below 2**61 in size) so that they are positive; a multiple of every block size.
BIAS = 1 << 61

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)
#: Bits of a word's number within its cell, which follow the number of the group in a packed key.
_WORD_BITS = CELL_BITS - STEP


def _ones(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with slots low..high-1 set, for 0 <= low < high <= 64."""
    return (_FULL >> (64 - (high - low)).astype(np.uint64)) << low.astype(np.uint64)


def _unite(words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words become one, with all their slots; the result is in order."""
    order = np.argsort(words, kind="stable")
    words, masks = words[order], masks[order]
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    return words[first], np.bitwise_or.reduceat(masks, first) if len(first) else masks


def blocks(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Canonical blocks of the union of [a, b) in each group, as (words, masks) of every level.

    ``group`` numbers the cells from 0, bounds lie in 0..2**36 with a < b. A word is ``group`` * 2**30 +
    its number at the level; slot i of word w at level r is the block [(64 w + i) 64**r, (64 w + i + 1) 64**r).

    1. Each interval is decomposed: at every level the part that is not aligned to the next one gives a
       head and a tail of slots.
    2. Siblings are merged upward: equal words unite, and a full word becomes a slot of its parent, which
       may thereby be filled in turn. The topmost word of a full cell stays.
    3. Words that lie in a block of a higher level are removed.
    """
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    up_words, up_masks = np.empty(0, np.int64), np.empty(0, np.uint64)
    base = group << _WORD_BITS
    for r in range(LEVELS):
        size = STEP * r
        lo, hi = (a + (1 << size) - 1) >> size, b >> size
        some = lo < hi
        lo, hi, at = lo[some], hi[some], base[some]
        first, last = lo >> STEP, (hi - 1) >> STEP
        slot_lo, slot_hi = lo & 63, ((hi - 1) & 63) + 1
        same = first == last
        top = r == LEVELS - 1  # nothing above takes an aligned middle
        head = top | (slot_lo != 0) | (same & (slot_hi != 64))
        tail = ~same & (slot_hi != 64)
        words = np.concatenate([at[head] + first[head], at[tail] + last[tail], up_words])
        masks = np.concatenate([_ones(slot_lo[head], np.where(same, slot_hi, 64)[head]), _ones(np.zeros(int(tail.sum()), np.int64), slot_hi[tail]), up_masks])
        words, masks = _unite(words, masks)
        if not top:
            full = masks == _FULL
            number = words[full] & ((1 << _WORD_BITS) - 1)
            up_words = (words[full] - number) + (number >> STEP)
            up_masks = _ONE << (number & 63).astype(np.uint64)
            words, masks = words[~full], masks[~full]
        levels.append((words, masks))
    for r in range(LEVELS - 2, -1, -1):
        words, masks = levels[r]
        number = words & ((1 << _WORD_BITS) - 1)
        covered = np.zeros(len(words), bool)
        for up in range(r + 1, LEVELS):
            above, slots = levels[up]
            if len(above) and len(words):
                ancestor = number >> (STEP * (up - r - 1))
                wanted = (words - number) + (ancestor >> STEP)
                place = np.minimum(np.searchsorted(above, wanted), len(above) - 1)
                covered |= (above[place] == wanted) & ((slots[place] >> (ancestor & 63).astype(np.uint64)) & _ONE == _ONE)
        levels[r] = words[~covered], masks[~covered]
    return levels


def runs(levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, lo, hi) of the coalesced runs of adjacent blocks, in order. Blocks of a canonical set do not overlap."""
    groups, los, his = [], [], []
    for r, (words, masks) in enumerate(levels):
        number = words & ((1 << _WORD_BITS) - 1)
        g, start = words >> _WORD_BITS, number << STEP
        begin, end = masks & ~(masks << _ONE), masks & ~(masks >> _ONE)
        while len(begin):
            low, high = begin & (~begin + _ONE), end & (~end + _ONE)  # the lowest run of each word
            groups.append(g)
            los.append((start + np.log2(low.astype(np.float64)).astype(np.int64)) << (STEP * r))
            his.append((start + np.log2(high.astype(np.float64)).astype(np.int64) + 1) << (STEP * r))
            begin, end = begin ^ low, end ^ high
            more = begin != 0
            begin, end, g, start = begin[more], end[more], g[more], start[more]
    if not groups:
        return (np.empty(0, np.int64),) * 3
    g, lo, hi = np.concatenate(groups), np.concatenate(los), np.concatenate(his)
    order = np.lexsort((lo, g))
    g, lo, hi = g[order], lo[order], hi[order]
    opens = np.r_[True, (g[1:] != g[:-1]) | (lo[1:] != hi[:-1])]
    closes = np.r_[opens[1:], True]
    return g[opens], lo[opens], hi[closes]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a sorted column differs from the row before; nulls are equal to each other, so are NaNs."""
    now, then = column.slice(1), column.slice(0, len(column) - 1)
    missing = pc.is_null(column, nan_is_null=pa.types.is_floating(column.type)).to_numpy(zero_copy_only=False)
    differs = pc.fill_null(pc.not_equal(now, then), True).to_numpy(zero_copy_only=False)
    return np.where(missing[1:] & missing[:-1], False, differs | (missing[1:] != missing[:-1]))


def _tiles(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, lo, hi, holes): a tile is a stretch of a key's time with the holes in it, biased bounds.

    A cell gives a tile for each Arrow batch that its intervals fill, so tiles of one key may overlap;
    tiles come in order of their first interval, so a hole of a tile can only be covered by an earlier one.
    Stretches of whole cells, of intervals longer than a cell, are merged the same way in units of cells;
    each of their runs is a tile without holes.
    """
    names = [f"k{i}" for i in range(len(keys))]
    d = df.where(F.col(end) > F.col(start)).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], (F.col(start) + F.lit(BIAS)).alias("a"), (F.col(end) + F.lit(BIAS)).alias("b"))
    cell_a, cell_b = F.shiftright("a", CELL_BITS), F.shiftright(F.col("b") - 1, CELL_BITS)
    edge_a, edge_b = F.shiftleft(cell_a + 1, CELL_BITS), F.shiftleft(cell_b, CELL_BITS)
    piece = lambda cell, a, b: F.struct(cell.alias("cell"), a.alias("a"), b.alias("b"))
    none, zero, whole = F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), F.lit(1 << CELL_BITS)
    inside = lambda c: c.bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    one = F.array(piece(cell_a, inside(F.col("a")), F.col("b") - F.shiftleft(cell_a, CELL_BITS)))
    several = F.array_compact(
        F.array(
            piece(cell_a, inside(F.col("a")), whole),
            F.when(edge_a < edge_b, piece(none, cell_a + 1, cell_b)),
            piece(cell_b, zero, F.col("b") - edge_b),
        )
    )
    cut = d.select(*names, F.inline(F.when(cell_a == cell_b, one).otherwise(several)))
    cut = cut.repartition(*names, "cell").sortWithinPartitions(*names, "cell", "a", "b")
    holes = pa.list_(pa.struct([("stop", pa.int64()), ("go", pa.int64())]))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows - 1, bool)
            for n in (*names, "cell"):
                changed |= _changes(batch.column(n))
            starts = np.r_[0, np.flatnonzero(changed) + 1]
            group = np.zeros(batch.num_rows, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            g, lo, hi = runs(blocks(group, batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            cells = batch.column("cell").take(pa.array(starts))
            large = cells.is_null().to_numpy(zero_copy_only=False)[g]
            shift = np.where(large, 0, pc.fill_null(cells, 0).to_numpy(zero_copy_only=False)[g] << CELL_BITS)
            unit = np.where(large, CELL_BITS, 0)
            lo, hi = (lo << unit) + shift, (hi << unit) + shift
            # a tile is a group of a cell, or a run of whole cells: what lies between those is up to their own tiles
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | large[1:]])
            last = np.r_[first[1:], len(g)] - 1
            inner = np.ones(len(g), bool)
            inner[first] = False
            offsets = np.r_[0, np.cumsum(last - first)].astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(hi[:-1][inner[1:]]), pa.array(lo[inner])], fields=list(holes.value_type))
            take = pa.array(starts[g[first]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(take) for n in names), pa.array(lo[first]), pa.array(hi[last]), pa.ListArray.from_arrays(pa.array(offsets), found, type=holes)],
                names=[*names, "lo", "hi", "holes"],
            )

    bounds = T.StructType([T.StructField("stop", T.LongType()), T.StructField("go", T.LongType())])
    schema = T.StructType([*(T.StructField(n, cut.schema[n].dataType) for n in names), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("holes", T.ArrayType(bounds))])
    tiles = cut.mapInArrow(run, schema)
    # One row per key and cell from here on: the tiles of a key in order, and how far those before reach.
    before = Window.partitionBy(*names).orderBy(F.col("lo"), F.col("hi").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.withColumn("reach", F.max("hi").over(before))
    # What an earlier tile covers is no hole, and where a tile begins beyond all earlier ones is one more.
    left = F.transform(F.filter("holes", lambda x: F.col("reach").isNull() | (x["go"] > F.col("reach"))), lambda x: F.struct(F.greatest(x["stop"], F.col("reach")).alias("stop"), x["go"].alias("go")))
    gap = F.when(F.col("lo") > F.col("reach"), F.array(F.struct(F.col("reach").alias("stop"), F.col("lo").alias("go"))))
    return tiles.select(*names, "lo", "hi", "reach", F.concat(F.coalesce(gap, F.array().cast(T.ArrayType(bounds))), left).alias("holes"))


def _named(keys: list[str]) -> list:
    return [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]


def gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Uncovered stretches of each key between its first start and last end: (keys, gap_start, gap_end).

    Bounds are whole numbers; touching intervals leave no gap, empty or reversed intervals and null
    bounds do not count, repeated rows change nothing, null keys form their own group; other columns are
    ignored.

    Blocks are made and merged inside cells of 2**36 units, so a key of any size spreads over its cells;
    across cells there is one row for each.
    """
    holes = _tiles(df, keys, start, end).select("*", F.explode("holes").alias("hole"))
    return holes.select(*_named(keys), (F.col("hole.stop") - F.lit(BIAS)).alias("gap_start"), (F.col("hole.go") - F.lit(BIAS)).alias("gap_end"))


def periods(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Continuous busy periods of each key: (keys, period_start, period_end); rules as in :func:`gaps`."""
    names = [f"k{i}" for i in range(len(keys))]
    tiles = _tiles(df, keys, start, end)
    order = lambda: Window.partitionBy(*names).orderBy("lo", F.col("hi").desc())
    # Between two holes of one tile lies a whole period. The last period of a tile ends where the next
    # hole of the key begins, or with the key: one row per tile takes part in that.
    some = F.size("holes") > 0
    d = tiles.withColumn("top", F.max("hi").over(order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(some | F.col("reach").isNull())
    d = d.withColumn("until", F.coalesce(F.lead(F.get("holes", F.lit(0))["stop"]).over(order()), "top"))
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    begins = F.concat(F.when(F.col("reach").isNull(), F.array("lo")).otherwise(F.array().cast("array<bigint>")), F.col("holes.go"))
    stops = F.concat(F.when(F.col("reach").isNull(), F.col("holes.stop")).otherwise(F.slice("holes.stop", 2, F.greatest(F.size("holes") - 1, F.lit(0)))), F.array("until"))
    found = d.select(*names, F.explode(F.zip_with(begins, stops, span)).alias("p"))
    return found.select(*_named(keys), (F.col("p.s") - F.lit(BIAS)).alias("period_start"), (F.col("p.e") - F.lit(BIAS)).alias("period_end"))
